"""Operators of the llm subpackage against brute force, round trips and hand-made cases."""

import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import arrow, boosting, budget, containers, leakage, lookalikes, mixing, pii, pii_examples, sentences, textstats, wrappers

RAW = "doc_id string, text string, language string, category string, source_id string, ingested_at timestamp"


def raw(spark, rows):
    return spark.createDataFrame([(k, t, g, c, s, None) for k, t, g, c, s in rows], RAW)


# --- problem 1 ----------------------------------------------------------------------------------------

SAME = [
    ("The open gate", "Тhе оpеn gаtе"), ("full width", "ｆｕｌｌ ｗｉｄｔｈ"), ("café", "café"), ("a b", "a b"), ("final", "ﬁnal"), ("word", "wo​r­d"),
    ("5 KΩ", "5 KΩ"), ("x-y", "x‐y"), ("ộ", "ộ"), ("Замок", "Зaмoк"), ("сор", "cop"),
]
APART = [("Gate", "gate"), ("cafe", "café"), ("m2", "m²"), ("½", "1/2"), ("a\nb", "a b"), ("a  b", "a b"), ("٣", "3"), ("👩‍🔬", "👩🔬"), ("rn", "m"), ("0", "O"), ("l", "1")]


def test_forms_of_lookalikes():
    r = lookalikes.Resolver()
    for a, b in SAME:
        assert r.form(a) == r.form(b), (a, b)
    for a, b in APART:
        assert r.form(a) != r.form(b), (a, b)
    assert r.form("") == ""


def test_viterbi_picks_one_script(spark):
    rows = raw(spark, [("1", "the open gate of the scope and a rope", "en", None, None), ("2", "скоро море у горы россия просто вода", "ru", None, None)])
    model = lookalikes.bigram_model(rows)
    r = lookalikes.Resolver(model)
    assert r.form("a rоpe оf the gаte") == "a rope of the gate"
    assert r.form("cкopo мope") == "скоро море"


def test_lookalike_pairs(spark):
    rows = raw(spark, [("a", "one gate", "en", None, None), ("b", "оne gate", "en", None, None), ("c", "one gate", "en", None, None), ("d", "one gate", "EN", None, None), ("e", "one gate", None, None, None),
                       ("f", "one gаte", None, None, None), ("g", None, "en", None, None), ("h", "", "en", None, None), ("a", "one gate", "en", None, None)])
    got = {tuple(r) for r in lookalikes.lookalike_pairs(rows).collect()}
    assert got == {("a", "b"), ("b", "c"), ("e", "f")}
    assert lookalikes.lookalike_pairs(rows.limit(0)).count() == 0


def test_lookalike_classes_and_split_groups(spark, monkeypatch):
    spell = lambda i: "one g" + ("аa"[i % 2]) + "te"
    rows = raw(spark, [(f"k{i:03}", spell(i), "en", None, None) for i in range(60)] + [(f"x{i}", "the same", "en", None, None) for i in range(9)])
    got = {r.doc_id: (r.class_id, r.n_spellings, r.n_others) for r in lookalikes.lookalike_classes(rows).collect()}
    assert got == {f"k{i:03}": ("k000", 2, 30) for i in range(60)}
    pairs = {tuple(r) for r in lookalikes.lookalike_pairs(rows).collect()}
    monkeypatch.setattr(lookalikes, "GROUP", 7)
    assert {tuple(r) for r in lookalikes.lookalike_pairs(rows).collect()} == pairs
    assert len(pairs) == 900 and all(a < b for a, b in pairs)


def test_consistent_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "оne gate here", "eн", "x"), (2, None, None, "y"), (3, "", "", "z")], "doc_id int, text string, language string, _forms string")
    got = {r.doc_id: r for r in lookalikes.consistent(rows, model={}).collect()}
    assert got[1].text_form == "one gate here" and got[2].text_form is None and got[3].text_form == "" and got[1]._forms == "x"


# --- problem 2 ----------------------------------------------------------------------------------------

PROSE = "The river carries the sand towards the sea in spring. It leaves the heavy stones behind near the bridge. Nobody moves them."
JUNK = ["- red 4\n- blue 7\n- green 12\n- white 9\n- black 1\n- brown 8", "a;b;c;4.5\n1;2;;n/a\n7;8;9;x\n4;n/a;2;y", "{}[]#&*^%$ 88 <> @@ ~~ || ^^ %% && ## $$ 12 {} []", "\ufffdr\ufffd \ufffd\ufffd w\ufffdr\ufffd \ufffd\ufffdt", "qwe zxc " * 60,
        "Look at this list of things we have to buy.\n" + "\n".join(f"* thing {i}" for i in range(30)), "2023-01-01 05:00:01 INFO [a] x id=123456\n2023-01-02 06:10:01 WARN [b] y id=654321"]
CODE = "def f(x):\n    return x + 1\n\nfor i in range(3):\n    print(f(i));\n\nclass A:\n    pass\n"


def test_verdicts(spark):
    rows = raw(spark, [(f"j{i}", t, "en", "web", None) for i, t in enumerate(JUNK)] + [("p", PROSE, "en", "web", None), ("w", textwrap.fill(PROSE, 36), "en", None, None), ("c", CODE, "code", "code", None), ("n", None, None, None, None), ("e", "", None, None, None), ("p", PROSE, "en", "web", None)])
    got = {r.doc_id: r.natural for r in textstats.statistics(rows).collect()}
    assert got == {**{f"j{i}": False for i in range(len(JUNK))}, "p": True, "w": True, "c": True, "e": False}
    assert textstats.statistics(rows.limit(0)).count() == 0


JUNK_TEXT = [
    "slow noisy patient current joint. 61386 " * 30, "Kernel router rapid stencil exact lock furnace plateau. Weight record canal model balanced vacant sudden. Thin scheduler encoder joint stone gate tower.",
    "Das alte Tal das. Die Brücke am Tal die. Das innere Tor die Wiese das. Die kleine Stadt den.", "QmFzZTY0ZW5jb2RlZERhdGFXaXRob3V0U3BhY2Vz+Zm9v/YmFyYmF6cXV4QWJjRGVmR2hp\n" * 6,
    "gzumlcq gkcqijntph pxhuupl jqsrkvqov jxktrtjjvdp akech qhukzvhqev vrncswpekx zix dtzaea qihlirgvwapah tudrnh hzvfrutfh ajeilomehp cueefuhtnaeq jfusebvvula cagbhpn pdxqicuov ioirkbsr jczqtvr jai",
    "Read also: How deep is a gate?\nRelated: How old is a tower?\nRead also: How wide is a road?\nRelated: The old road and its gate",
]


def test_junk_of_other_kinds():
    for t in JUNK_TEXT:
        (c,) = textstats.whole_counts([t])
        assert not textstats.verdict(c, "web")[0], t
    for t in (PROSE, "水库保护了两条支流并保持稳定。", "[00-000621] 貯水池は約33メートルにわたって上流の堤防を遅らせた。", PROSE + "\n- the old gate\n- the stone tower"):
        (c,) = textstats.whole_counts([t])
        assert textstats.verdict(c, "web")[0], t


BITS = [PROSE, "- item 4\n- item 7", "a;b;5", "Short one. Ok!", "return x;", "def f(x):", "<b>bold</b>", "<script>let a = 1;</script>", "水库保护了两条支流，并保持稳定。", "é́x", "x" * 150, "\u200bfoo", "…", "of the", "12. b", "a " * 40]


def test_chunks_merge_to_the_whole():
    """All counts and the sketch agree for any size of chunk, with blank lines, without and in one line."""
    rng = random.Random(4)
    for _ in range(150):
        text = rng.choice(["\n\n", "\n", " ", ""]).join(rng.choice(BITS) for _ in range(rng.randrange(1, 30)))
        (whole,) = textstats.whole_counts([text])
        clean = textstats.cleaned(text)
        for size in (64, rng.randrange(65, 400), 1000):
            parts = list(textstats.cut_text(clean, size))
            assert "".join(clean[a:b] for a, b in parts) == clean
            states = [textstats.partials([(clean, a, b)])[0] for a, b in parts]
            while len(states) > 1:  # any tree
                i = rng.randrange(len(states) - 1)
                states[i: i + 2] = [textstats.merge(states[i], states[i + 1])]
            total = textstats.finish(states[0])
            assert (total[: textstats.NC] == whole[: textstats.NC]).all() and (total[textstats.SKETCH:] == whole[textstats.SKETCH:]).all()


def test_one_long_line_and_wide_lines():
    """A text without line breaks and lines beyond the width of wrapped ones, across chunk borders."""
    for text in ((PROSE + " ") * 1700, ("x, " * 900 + "\n" + "the end of it\n") * 40, "\n".join(["the stone of the gate is old and it leans towards"] * 5000)):
        clean = textstats.cleaned(text)
        states = [textstats.partials([(clean, a, b)])[0] for a, b in textstats.cut_text(clean, 4096)]
        total = states[0]
        for s in states[1:]:
            total = textstats.merge(total, s)
        (whole,) = textstats.whole_counts([text])
        assert (textstats.finish(total)[: textstats.NC] == whole[: textstats.NC]).all()


def test_chunk_size_changes_no_row(spark):
    rows = raw(spark, [(f"j{i}", t * 3, "en", "web", None) for i, t in enumerate([*JUNK, *JUNK_TEXT, PROSE, CODE])])
    assert sorted(map(tuple, textstats.statistics(rows).collect())) == sorted(map(tuple, textstats.statistics(rows, chunk=100).collect()))


def test_very_long_text(spark):
    long = "".join(f"The river number {i} carries the sand {i} towards the sea in spring. It leaves the heavy stones {i} behind near the bridge.\n\n" for i in range(3000))
    same = (PROSE + "\n\n") * 3000
    got = {r.doc_id: r for r in textstats.statistics(raw(spark, [("x", long, "en", "web", None), ("y", same, "en", "web", None)])).collect()}
    assert got["x"].natural and got["x"].n_words == len(long.split()) and got["x"].n_chars == sum(not c.isspace() for c in long)
    assert got["y"].rule == "repeated" and got["y"].n_words == len(same.split())


# --- problem 3 ----------------------------------------------------------------------------------------


def test_containers(spark):
    rng = random.Random(2)
    arrays = [[1] * n for n in [rng.randrange(1, 90) for _ in range(300)] + [250, 100, 200, 101]] + [[], None]
    rows = [(f"d{i}", a) for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id string, token_ids array<int>").repartition(6)
    got = containers.assignment(df, capacity=100).collect()
    assert sorted((r.doc_id, r.part_no, r.first_token, r.length) for r in got) == sorted(
        (k, p, p * 100, min(100, len(a) - p * 100)) for k, a in rows if a for p in range(-(-len(a) // 100)))
    used = {}
    for r in got:
        cells = used.setdefault(r.container, set())
        new = set(range(r.offset, r.offset + r.length))
        assert not cells & new and r.offset + r.length <= 100
        cells |= new
    total = sum(len(a or []) for a in arrays)
    assert len(used) <= 1.03 * total / 100 + 1
    again = containers.assignment(df.repartition(2), capacity=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert {r[0] for r in containers.cut_documents(containers.assignment(df, capacity=100)).collect()} == {k for k, a in rows if a and len(a) > 100}
    assert containers.assignment(df.limit(0), capacity=100).count() == 0


def test_plan_is_best_fit_for_a_hot_length():
    places, n, _ = containers.plan({60: 10**6, 40: 10**6, 30: 5}, 100)
    assert n == 10**6 + 2 and places[60] == [(0, 0, 0)]


# --- problem 4 ----------------------------------------------------------------------------------------


def tale(i, k):
    rng = random.Random(f"{i}-{k}")
    word = lambda: rng.choice("river sand bridge stone spring tower ship road hill gate".split())
    return f"The {word()} carries the {word()} towards the {word()} in the {word()}. It leaves the {word()} behind near the {word()} of the {word()}."


def page(host, i):
    return f"We use biscuits here. Accept all | Settings\nHome · About · Login\nStory number {i} of the hill\n{tale(i, 0)} Part {i * 37} was kept by the old keeper in the tower.\nAdvertisement\n{tale(i, 1)}\nRead also: The tale of {i * 11} ships\n© 2020 {host}. All rights reserved."


def test_wrappers(spark):
    rows = [(f"{h}-{i}", page(f"h{h}.example", h * 10 + i), f"https://h{h}.example/{i}") for h in range(6) for i in range(5)]
    rows += [("one", page("lone.example", 99), "https://lone.example/1"), ("links", "We use biscuits here. Accept all | Settings\nHome · About · Login\nAdvertisement\nThe tale of ships\n© 2020 h1.example. All rights reserved.", "https://h1.example/9"),
             ("plain", PROSE, None), ("null", None, None), ("empty", "", None)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id string, text string, url string").repartition(4)
    got = {}
    for k, n in wrappers.boilerplate(df, url=F.col("url")).collect():
        got.setdefault(k, []).append(n)
    assert all(sorted(got[k]) == [0, 1, 4, 6, 7] for k, _, _ in rows[:30]), got
    assert sorted(got["one"]) == [0, 1, 4, 6, 7] and sorted(got["links"]) == [0, 1, 2, 3, 4]
    assert not {"plain", "null", "empty"} & set(got)
    body = {r.doc_id: r.body for r in wrappers.main_body(df, url=F.col("url")).collect()}
    assert body["one"].split("\n")[0] == "Story number 99 of the hill" and body["null"] is None and body["empty"] == "" and body["links"] == ""
    for k, t, _ in rows:
        assert t is None or body[k] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got.get(k, ())), k


def test_alignment_is_union_free():
    w = wrappers.Wrapper.of(list("abcxe")).align(wrappers.Wrapper.of(list("abdde")))
    tokens = [(n.token, n.pages, n.repeated) for n in w.nodes]
    assert ("a", 2, False) in tokens and ("e", 2, False) in tokens and ("x", 1, False) in tokens and ("d", 1, True) in tokens
    assert [t for t, p, _ in tokens if p == 2] == ["a", "b", "e"]
    assert [(n.token, n.repeated) for n in wrappers.Wrapper.of(list("ababcd")).nodes] == [("a", True), ("b", True), ("c", False), ("d", False)]
    # gaps are aligned again: "h" comes twice on the left, once in the gap between "m" and "z"
    assert wrappers.matches(list("ahmhz"), list("mhz")) == [(2, 0), (3, 1), (4, 2)]
    text = wrappers.expression(wrappers.Wrapper.of(["Home", "t1", "\x01", "End"]).align(wrappers.Wrapper.of(["Home", "t2", "\x01", "\x01", "Ad", "End"])))
    assert text == "Home\n(#)+?\n(#)+\n(#)?\nEnd"


def boilerplate_of(df):
    got = {}
    for k, n in wrappers.boilerplate(df, url=F.col("url")).collect():
        got.setdefault(k, []).append(n)
    return {k: sorted(v) for k, v in got.items()}


def test_hot_host_and_own_lines(spark):
    """One host with half of the pages in several parts; a notice only this host has, one of 2,600 characters among them."""
    notice = "Members of the harbor circle read the archive without limits " + "and the annex of the archive too " * 80
    own = lambda i: page("hot.example", i).replace("Advertisement", f"Harbor circle members only\n{notice}")
    rows = [(f"hot-{i}", own(i), f"https://hot.example/{i}") for i in range(300)]
    rows += [(f"{h}-{i}", page(f"h{h}.example", 1000 + h * 10 + i), f"https://h{h}.example/{i}") for h in range(60) for i in range(5)]
    got = boilerplate_of(spark.createDataFrame(rows, "doc_id string, text string, url string").repartition(5))
    assert all(got[f"hot-{i}"] == [0, 1, 4, 5, 7, 8] for i in range(300))
    assert all(got[f"{h}-{i}"] == [0, 1, 4, 6, 7] for h in range(60) for i in range(5))


def test_templates_do_not_depend_on_the_number_of_hosts(spark):
    """A notice on four hosts is known among 30 hosts and among 300."""
    rare = lambda h, i: page(f"h{h}.example", h * 10 + i).replace("Advertisement", "Printed on the old press" if h < 4 else "Advertisement")
    for hosts in (30, 300):
        rows = [(f"{h}-{i}", rare(h, i), f"https://h{h}.example/{i}") for h in range(hosts) for i in range(3)]
        got = boilerplate_of(spark.createDataFrame(rows, "doc_id string, text string, url string"))
        assert all(got[f"{h}-{i}"] == [0, 1, 4, 6, 7] for h in range(4) for i in range(3))


def test_scripts_and_copies(spark):
    lone = "<script>\nlet a = 1;\n</script>\n" + tale(1, 1) + "\n" + tale(1, 2)
    copies = [(f"c{i}", page("copy.example", 7), "https://copy.example/7") for i in range(5)]  # one article delivered five times is one page
    rows = [("lone", lone, None), *copies, *[(f"{h}-{i}", page(f"h{h}.example", h * 10 + i), f"https://h{h}.example/{i}") for h in range(6) for i in range(5)]]
    got = boilerplate_of(spark.createDataFrame(rows, "doc_id string, text string, url string"))
    assert got["lone"] == [0, 1, 2] and all(got[f"c{i}"] == [0, 1, 4, 6, 7] for i in range(5))


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 3_000_000, 5, 900_000, 900_000, 7)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([[t] for t in texts]), pa.array(range(7))], names=["a", "b", "c"]).slice(1)
    parts = list(arrow.by_bytes(batch))
    assert [v for p in parts for v in p.column("a").to_pylist()] == texts[1:]
    sizes = [sum(arrow.row_bytes(c) for c in p.columns) for p in parts]
    assert all(s.sum() - s[-1] <= arrow.SLICE_BYTES for s in sizes) and len(parts) >= 3


# --- problem 5 ----------------------------------------------------------------------------------------


def test_budget_updates_equal_a_fresh_count(spark):
    def deliveries(seed):
        rng = random.Random(seed)
        return raw(spark, [(f"d{i}", rng.choice([None, "", "some words here", "more words", PROSE]), rng.choice(["en", "EN", "eng", None, "еn", "de-DE"]), rng.choice(["web", None]), rng.choice(["S_1", "s-1", None, "s_2​"])) for i in rng.sample(range(40), 30)])

    state = budget.State(spark)
    for seed in (1, 2, 3):
        cube = state.update(deliveries(seed))
    fresh = budget.State(spark).update(deliveries(3))
    assert sorted(map(tuple, cube.collect())) == sorted(map(tuple, fresh.collect()))
    names = {(r.source_id, r.language) for r in fresh.collect()}
    assert {s for s, _ in names} == {"*", "s_1", "s_2", "unknown"} and {g for _, g in names} == {"*", "en", "de", "unknown"}
    enc = budget.encoding(budget.VOCABULARY)
    want = sum(len(enc.encode_ordinary(r.text)) for r in deliveries(3).collect() if r.text)
    assert [r.n_tokens for r in fresh.where("source_id='*' and category='*' and language='*'").collect()] == [want]
    assert state.counts.count() == state.counts.select("content").distinct().count()
    again = budget.State(spark, folder=state.folder)
    assert sorted(map(tuple, again.cube.collect())) == sorted(map(tuple, cube.collect()))
    assert sorted(map(tuple, again.update(deliveries(4)).collect())) == sorted(map(tuple, budget.State(spark).update(deliveries(4)).collect()))
    # nothing is new: no text is read for encoding
    assert budget.counted(deliveries(4), again.counts).count() == 0
    known = again.counts.where("n_tokens < 3")
    few, many = (sorted(map(tuple, budget.counted(deliveries(4), known, most=m).collect())) for m in (0, 100))
    assert few == many and few
    assert budget.State(spark).update(deliveries(1).limit(0)).count() <= 1


# --- problem 6 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pii_model():
    return pii.train()


def pii_scores(lines, model):
    hits = true = found = 0
    for _, _, t, m in pii_examples.sample(4, seed=123, lines=lines):
        got = set(pii.mentions_of([t], model)[0])
        hits, true, found = hits + len(got & set(m)), true + len(m), found + len(got)
    return hits / true, hits / found


def test_pii_held_out_lines():
    """Whole lines are unknown to the model that reads them."""
    lines = pii_examples.all_lines()
    recall, precision = pii_scores(lines[3::5], pii.train(lines=[x for i, x in enumerate(lines) if i % 5 != 3]))
    assert recall >= 0.9 and precision >= 0.9


def test_pii_held_out_language():
    lines = pii_examples.all_lines()
    recall, precision = pii_scores([x for x in lines if x[0] == "es"], pii.train(lines=[x for x in lines if x[0] != "es"]))
    assert recall >= 0.85 and precision >= 0.85


def test_names_are_proposed_without_lists():
    """The generator has no gate of known names or contexts."""
    t = "Kofi Mensah opened the gate. Then Wanjiru N. Odhiambo-Clarke left."
    spans = {t[a:b] for k, a, b in pii.candidates(t) if k == 4}
    assert {"Kofi Mensah", "Wanjiru N. Odhiambo-Clarke"} <= spans
    for text in ("An\nder Mauer 4", "Auf\ndem Berg 12", "45 Quang Trung", "Hinter der Kirche, Kirchweg 3", "12 rue de\nla Paix"):
        assert any(k == 3 for k, _, _ in pii.candidates(text)), text


def test_pii_positions_and_redaction(spark, pii_model):
    text = "A note.\nReviewed-by: Ｆrank Miller <info@mel​hal.example> Version 2.14.18 of 2021-04-27."
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("a", text)], "doc_id string, text string")
    got = {tuple(r) for r in pii.mentions(rows, model=pii_model).collect()}
    name, mail = "Ｆrank Miller", "info@mel​hal.example"
    assert got == {("a", "name", text.index(name), text.index(name) + len(name)), ("a", "email", text.index(mail), text.index(mail) + len(mail))}
    red = {r.doc_id: r.redacted for r in pii.redacted(rows, model=pii_model).collect()}
    assert red == {"a": "A note.\nReviewed-by: [NAME] <[EMAIL]> Version 2.14.18 of 2021-04-27.", "b": None, "c": ""}


def test_boosting_learns_a_rule():
    rng = np.random.RandomState(0)
    x = rng.rand(800, 5)
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = boosting.fit(x[:600], y[:600])
    p = trees.score(x[600:])
    t = boosting.best_threshold(p, y[600:])
    assert ((p >= t) == y[600:]).mean() > 0.97


# --- problem 7 ----------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    out = set()
    for k, lang, t in items:
        w = leakage.words(t or "")
        n = leakage.run_length(lang, len(w))
        runs = {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if w else set()
        for d, x in docs:
            v = leakage.words(x or "")
            if any(tuple(v[i: i + n]) in runs for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def test_leaks(spark):
    rng = random.Random(8)
    vocab = ["river", "Gate", "stone", "über", "café", "tower", "seven", "old", "hill", "ship", "road", "fire"]
    items = [(i, "en", " ".join(rng.choice(vocab) + rng.choice(["", "", str(i)]) for _ in range(rng.choice([3, 9, 15, 30])))) for i in range(12)]
    items += [(50, "zh", "水库保护了两条支流并保持稳定缓存记录了梯田与去年相同索引表调整了"), (51, "en", None), (52, "en", "...")]
    docs = []
    for d in range(60):
        w = leakage.words(rng.choice(items[:12])[2])
        a = rng.randrange(max(1, len(w) - 12))
        piece = w[a: a + rng.choice([5, 11, 12, 13, 40])]
        if rng.random() < 0.3 and len(piece) > 6:
            piece[5] = "changed"
        form = rng.choice([" ".join, ", ".join, lambda x: "<b>" + "</b> <i>".join(x).upper() + "</i>", "\n".join])
        docs.append((d, f"Start {rng.choice(vocab)} " + form(piece) + " end " + rng.choice(vocab)))
    docs += [(100, "前文。水库保护了两条支流，并保持稳定。缓存记录了梯田，与去年相同。索引表"), (101, None), (102, "")]
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string")
    idf = spark.createDataFrame(items, "item_id bigint, lang string, text string")
    got = {tuple(r) for r in leakage.leaks(ddf, idf).collect()}
    assert got == brute_leaks(docs, items) and got
    near = {(r.doc_id, r.item_id) for r in leakage.regions(ddf, idf).collect()}
    assert near >= got
    assert leakage.leaks(ddf, idf.limit(0)).count() == 0 and leakage.leaks(ddf.limit(0), idf).count() == 0


def test_text_between_comparison_signs_is_searched(spark):
    passage = "the seven grey herons left the northern marsh before the first frost of winter came"
    docs = [
        f"let x < 5 be given. {passage.capitalize()}.\nThen y > 3 holds",
        f"if a <b and {passage} or c> d",
        f"x<y {passage} z>0",
        passage.replace(" herons", "<b>\n herons</b>").replace("frost", '<a href="u" hidden>frost</a><br/>').replace("left", "<!-- a > b\n -->left<IMG SRC=x.png alt>"),
        passage.replace("left", "< 5 left"),
    ]
    ddf = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    idf = spark.createDataFrame([(7, "en", passage)], "item_id bigint, lang string, text string")
    assert {r.doc_id for r in leakage.leaks(ddf, idf).collect()} == {0, 1, 2, 3}
    assert {r.doc_id for r in leakage.regions(ddf, idf).collect() if r.exact} == {0, 1, 2, 3}


def test_banded_alignment():
    run = " the quick river gate opened for seven old ships "
    assert leakage.banded("xx" + run + "yy", run, 1) == 0 and leakage.banded("xx" + run.replace("seven", "sevn") + "yy", run, 1) == 1
    assert leakage.banded("xx" + run.replace("seven", "se en").replace("gate", "gat") + "yy", run, 1) == 2
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(4, 12)))
        t = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 14)))
        row = [0] * (len(t) + 1)  # edit distance to the best stretch, by the whole table
        for i, ch in enumerate(a, 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (t[j - 1] != ch)))
            row = new
        for k in (1, 2):
            assert leakage.banded(t, a, k) == min(min(row), k + 1), (t, a, k)


def test_one_edit_is_a_region(spark):
    item = "the quick river gate opened for seven old ships near the tower of stone at dawn"
    ddf = spark.createDataFrame([(1, "well " + item.replace("seven", "sevem") + " so"), (2, item.replace("seven", "all the many"))], "doc_id bigint, text string")
    idf = spark.createDataFrame([(9, "en", item)], "item_id bigint, lang string, text string")
    assert {(r.doc_id, r.exact) for r in leakage.regions(ddf, idf).collect()} >= {(1, False)}
    assert leakage.leaks(ddf, idf).count() == 0


# --- problem 8 ----------------------------------------------------------------------------------------


def test_route_is_cheapest():
    flow = mixing.route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {("a",): 3, ("a", "b"): 2, ("b",): 2}, {"a": 100, "b": 60})
    assert flow == {(("a",), "a"): 100, (("a", "b"), "b"): 50, (("b",), "b"): 10}
    flow = mixing.route({("a",): 10, ("a", "b"): 10}, {("a",): 3, ("a", "b"): 3}, {"a": 25, "b": 25, "c": 5})
    got = {s: sum(v for (_, t), v in flow.items() if t == s) for s in "abc"}
    assert got["a"] + got["b"] == 50 and got["c"] == 0
    sent = {p: sum(v for (q, _), v in flow.items() if q == p) for p in (("a",), ("a", "b"))}
    assert all(v <= 30 for v in sent.values())


def cheapest(supply, limit, quota):
    """(flow, cost) by successive shortest paths over the whole network, one token at a time."""
    edges = []  # from, to, room, cost
    graph = {}

    def edge(a, b, room, cost):
        graph.setdefault(a, []).append(len(edges))
        edges.append([b, room, cost])
        graph.setdefault(b, []).append(len(edges))
        edges.append([a, 0, -cost])

    for p, n in supply.items():
        for use in range(1, limit[p] + 1):
            edge("start", p, n, use)
        for s in p:
            if s in quota:
                edge(p, ("s", s), 10**9, 0)
    for s, q in quota.items():
        edge(("s", s), "end", q, 0)
    total = cost = 0
    while True:
        far, via = {"start": 0}, {}
        for _ in range(len(graph)):
            for a in list(far):
                for e in graph.get(a, []):
                    b, room, c = edges[e]
                    if room > 0 and far[a] + c < far.get(b, 10**9):
                        far[b], via[b] = far[a] + c, (a, e)
        if "end" not in far:
            return total, cost
        at, path = "end", []
        while at != "start":
            at, e = via[at]
            path.append(e)
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
        total, cost = total + amount, cost + amount * far["end"]


def test_route_is_optimal():
    rng = random.Random(12)
    for _ in range(60):
        names = [chr(97 + i) for i in range(rng.randrange(1, 5))]
        supply = {tuple(sorted(rng.sample([*names, "other"], rng.randrange(1, len(names) + 1)))): rng.randrange(1, 12) for _ in range(rng.randrange(1, 7))}
        limit, quota = {p: rng.randrange(1, 4) for p in supply}, {s: rng.randrange(0, 25) for s in names}
        flow = mixing.route(supply, limit, quota)
        sent = {p: sum(v for (q, _), v in flow.items() if q == p) for p in supply}
        assert all(v >= 0 and s in p for (p, s), v in flow.items()) and all(sent[p] <= limit[p] * n for p, n in supply.items())
        assert all(sum(v for (_, t), v in flow.items() if t == s) <= q for s, q in quota.items())
        cost = sum(sum(use * min(n, max(0, sent[p] - (use - 1) * n)) for use in range(1, limit[p] + 1)) for p, n in supply.items())
        assert (sum(sent.values()), cost) == cheapest(supply, limit, quota)


def test_many_patterns_are_routed_fast():
    rng = random.Random(2)
    names = [f"s{i}" for i in range(40)]
    supply = {tuple(sorted(rng.sample(names, rng.randrange(1, 6)))): rng.randrange(1, 1000) for _ in range(60000)}
    share = sum(supply.values()) // 45
    flow = mixing.route(supply, dict.fromkeys(supply, 2), dict.fromkeys(names, share))
    assert len(supply) > 30000 and sum(flow.values()) == 40 * share


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randrange(5, 40) + str(i), "big" if i % 3 else "small") for i in range(600)] + [(1000 + i, f"shared text number {i} " * 4, s) for i in range(30) for s in ("big", "small")][:60]
    docs = [(n, t, s) for n, (_, t, s) in enumerate(docs)] + [(5000, None, "big"), (5001, "", "big"), (5002, "x y", None)]
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("even", "big", 0.5, 2), ("even", "small", 0.5, 3), ("hard", "small", 0.7, 1), ("hard", "gone", 0.3, 4)], "policy_id string, source string, target_share double, max_repeats int")
    drawn, quotas = mixing.draws(ddf, targets)
    rows = drawn.collect()
    assert rows and all(r.uses <= 3 for r in rows) and all(r.uses <= 1 for r in rows if r.policy_id == "hard")
    by = {(r.policy_id, r.source): r for r in mixing.shares(drawn, quotas, targets).collect()}
    assert abs(by["even", "big"].reached_share - 0.5) < 0.01 and by["even", "small"].met and not by["hard", "gone"].met
    assert by["hard", "gone"].tokens == 0
    again = sorted(map(tuple, mixing.draws(ddf.repartition(7), targets)[0].collect()))
    assert sorted(map(tuple, rows)) == again
    assert mixing.draws(ddf.limit(0), targets)[0].count() == 0 and mixing.draws(ddf, targets.limit(0))[0].count() == 0


# --- problem 9 ----------------------------------------------------------------------------------------

LEARN = ["Dr. {n} came. The gate is open. It was Fig. 4 of the book, e.g. the old one. Each {w} moves.", "The {w} holds. Dr. {n} saw Fig. 7 and left. We went on! Each {w} stays. Was it Mr. {n}? The end."]


@pytest.fixture(scope="module")
def models(spark):
    rng = random.Random(3)
    names, things = ["Belheim", "Tarver", "Zansory", "Keslund", "Pirova"], ["river", "tower", "ship", "stone"]
    texts = [" ".join(rng.choice(LEARN) for _ in range(3)).replace("{n}", rng.choice(names)).replace("{w}", rng.choice(things)) for _ in range(200)]
    return sentences.learn(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"))


def cut(text, lang, models):
    return [text[a:b] for a, b in sentences.sentences(text, lang, models)]


def test_sentences(models):
    assert {"dr", "fig"} <= models["en"].abbreviations and "the" in models["en"].starters
    assert cut("Title here\n\nDr. Belheim saw it. The gate\nis 4.5 m wide.  It (see Fig. 4) is open!", "en", models) == ["Title here", "Dr. Belheim saw it.", "The gate\nis 4.5 m wide.", "It (see Fig. 4) is open!"]
    assert cut("“Is it open?” asked the keeper. She wrote “It is.” The end.", "en", models) == ["“Is it open?” asked the keeper.", "She wrote “It is.”", "The end."]
    assert cut("User: Hi there. Go on.\nAssistant: No.\nUser: Why?", "en", models) == ["User: Hi there.", "Go on.", "Assistant: No.", "User: Why?"]
    assert cut("水库记录了数据。缓存（见图3）稳定！他写道：「第3页有误。」", "zh", models) == ["水库记录了数据。", "缓存（见图3）稳定！", "他写道：「第3页有误。」"]
    assert cut("यह खुला है। क्या वह आया? हाँ।", "hi", models) == ["यह खुला है।", "क्या वह आया?", "हाँ।"]
    assert cut("Wait... then it moved. Read config.yaml from docs.example now. A frame.Of the rest", "en", models) == ["Wait... then it moved.", "Read config.yaml from docs.example now.", "A frame.", "Of the rest"]


def test_rare_abbreviations_are_learned_in_large_corpora(spark):
    dull = " ".join(f"tower river stone ship {w}" for w in ("holds", "stays", "moves", "waits") * 250)  # 5,000 words
    texts = [f"We saw Qzv. Tarver {w}. {dull}." for w in ("come", "leave", "sing", "wait")]
    texts += [f"The {w} holds. Each keeper stays. We saw one {w}. {dull}." for w in ("river", "tower", "ship", "stone", "gate", "lamp", "rope", "well")] * 50  # 2 M words
    texts += ["Then two bells rang at sunset. Each keeper stays. "] * 3 + ["He called at sunset now and at sunset then."]
    learned = sentences.learn(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"))
    assert "qzv" in learned["en"].abbreviations and ("qzv", "tarver") in learned["en"].collocations
    # two sightings without the period tell this word from an abbreviation
    assert "sunset" not in learned["en"].abbreviations


def test_units_cover_all_text(spark, models):
    rng = random.Random(9)
    bits = ["A b. ", "“Q?” x ", "\n\n", "(c.) ", "Dr. X ", "1. ", "…", "。", "\n", " ", "!", "d"]
    texts = ["".join(rng.choice(bits) for _ in range(40)) for _ in range(200)]
    for t in texts:
        spans = sentences.sentences(t, "en", models)
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(t[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == t.replace(" ", "").replace("\n", "")
    df = spark.createDataFrame([(1, "en", "Yes. No."), (2, None, None), (3, "en", ""), (4, "en", "  \n "), (1, "en", "Yes. No.")], "doc_id int, lang string, text string")
    assert {tuple(r) for r in sentences.units(df, models).collect()} == {(1, 0, 4), (1, 5, 8)}


# --- edges of all operators ---------------------------------------------------------------------------


def test_empty_tables_and_null_columns(spark):
    nulls = spark.createDataFrame([(None, None, None, None, None, None), ("a", None, None, None, None, None)], RAW)
    for rows in (nulls.limit(0), nulls):
        assert lookalikes.lookalike_pairs(rows).count() == 0
        assert textstats.statistics(rows).count() == 0
        assert wrappers.boilerplate(rows).count() == 0 and wrappers.expressions(rows).count() == 0
        assert pii.mentions(rows).count() == 0
        docs = rows.select("doc_id", "text", F.col("language").alias("lang"), F.col("source_id").alias("source"))
        assert sentences.units(docs, sentences.learn(docs)).count() == 0
        assert containers.assignment(rows.select("doc_id", F.lit(None).cast("array<int>").alias("token_ids"))).count() == 0
        total = [r.n_docs for r in budget.State(spark).update(rows).where("source_id = '*' and category = '*' and language = '*'").collect()]
        assert total in ([], [1])
        targets = spark.createDataFrame([(None, None, None, None), ("p", "s", None, None)], "policy_id string, source string, target_share double, max_repeats int")
        drawn, quotas = mixing.draws(docs, targets)
        assert drawn.count() == 0 and [r.met for r in mixing.shares(drawn, quotas, targets).collect()] == [True]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("a", "Dr. Frank Belheim lives here. It is so.", "en", "web", 1, "x", 2, 3)], "doc_id string, text string, language string, category string, k int, t string, n int, body int")
    assert textstats.statistics(rows).count() == 1
    assert sorted(wrappers.main_body(rows).columns) == sorted(rows.columns)
    assert pii.mentions(rows).count() == 1
    assert lookalikes.consistent(rows, model={}).columns == [*rows.columns, "text_form", "language_form"]


def test_one_very_long_text(spark, pii_model):
    long = "The river carries the sand to the sea. " * 20000 + "Reviewed-by: Frank Belheim <info@melhal.example>"
    rows = spark.createDataFrame([("a", long, "en")], "doc_id string, text string, lang string")
    assert {r.kind for r in pii.mentions(rows, model=pii_model).collect()} == {"name", "email"}
    assert sentences.units(rows, sentences.learn(rows)).count() > 19000
    items = spark.createDataFrame([(1, "en", "sand to the sea. The river carries the sand to the sea. The river")], "item_id bigint, lang string, text string")
    assert leakage.leaks(rows, items).count() == 1
    assert lookalikes.consistent(rows.withColumnRenamed("lang", "language"), model={}).first().text_form == long
