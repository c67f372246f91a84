"""Labelled lines for training and calibrating the redaction model.

The lines are made-up letters, forms, signatures, notices, code and tables in five languages, with mentions in
the publicly documented formats of telephone, identity and postal systems.  A mention is written
``[kind|*]``.  Letters in braces are filled at random: {G} given name, {S} family name, {P} place, {W} word,
{d} digit, {D} digit but 0, {L} capital letter, {E} mailbox, {H} host.  Names are partly common ones and
partly syllables, so that the model cannot rest on lists.  ``LINES`` times ``COPIES`` is the whole sample, a
bound that does not depend on the corpus.
"""

from __future__ import annotations

import random
import re

COPIES, SAMPLE_SEED = 30, 11

# Common given names of four languages, and the parts of Vietnamese names.
GIVEN = {
    "en": "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Betty Paul Emily Steven Laura Andrew Rachel Kevin Helen Brian Anna George Grace Frank Alice Peter Emma Henry Oscar Simon Victor Nathan Liam Irene Monica Julia Oliver Martin Jason Walter Ruth Sophie Harry Lucy Adam".split(),
    "de": "Peter Ursula Michael Monika Thomas Petra Andreas Sabine Wolfgang Renate Klaus Karin Jürgen Brigitte Günter Ingrid Stefan Andrea Christian Gabriele Uwe Heike Werner Susanne Horst Claudia Frank Birgit Dieter Anke Jens Silke".split(),
    "fr": "Jean Marie Pierre Jeanne Michel Françoise André Monique Philippe Catherine Alain Nathalie Bernard Isabelle Jacques Sylvie Daniel Martine Nicolas Anne François Christine Julien Hélène Benoît Chloé Jérôme Élise".split(),
    "es": "Antonio María José Carmen Manuel Ana Francisco Isabel Juan Dolores David Pilar Javier Teresa Carlos Laura Jesús Cristina Alejandro Marta Miguel Elena Rafael Lucía Pedro Rosa Pablo Sofía Diego Raúl".split(),
}
VI_FAMILY = "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý".split()
VI_MIDDLE = "Văn Thị Minh Ngọc Đình Hữu Đức Quang Thanh Xuân Khắc Kim Công Bá".split()
VI_GIVEN = "An Bình Châu Dũng Giang Hà Hải Hoa Hùng Lan Linh Long Mai Nam Nga Phong Phúc Quân Sơn Thảo Trang Tuấn Vân Yến".split()
SURNAMES = {
    "en": "Smith Johnson Brown Taylor Wilson Davies Evans Walker Roberts Wright Clarke Hughes Parker Cooper Baker Turner Murphy Campbell Sullivan Bennett".split(),
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Neumann Krüger Zimmermann".split(),
    "fr": "Martin Bernard Dubois Robert Richard Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia Roux Fournier Girard Bonnet".split(),
    "es": "García González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Ruiz Díaz Álvarez Moreno Muñoz Romero Navarro Torres".split(),
}
ONSETS, NUCLEI, CODAS = "b d f g h k l m n p r s t v w z br dr gr kl pl st tr sch ch".split(), "a e i o u au ei ie oo".split(), "l n r s t m nd rt ck ld ng".split()
WORDS = "budget contract garden invoice kitchen lecture meeting package printer project report server ticket vehicle window workshop".split()
NOUNS = {
    "de": "Vertrag Garten Rechnung Küche Vortrag Paket Drucker Bericht Fahrzeug Fenster".split(), "fr": "contrat jardin facture cuisine conférence colis imprimante rapport véhicule fenêtre".split(),
    "es": "contrato jardín factura cocina charla paquete impresora informe vehículo ventana".split(), "vi": "hợp đồng khu vườn hóa đơn nhà bếp bài giảng bưu kiện máy in báo cáo".split(),
}

PHONES = {
    "en": ["({D}{d}{d}) {D}{d}{d}-{d}{d}{d}{d}", "({D}{d}{d}) {D}{d}{d} {d}{d}{d}{d}", "{D}{d}{d}-{D}{d}{d}-{d}{d}{d}{d}", "{D}{d}{d}.{D}{d}{d}.{d}{d}{d}{d}", "{D}{d}{d} {D}{d}{d} {d}{d}{d}{d}", "+1 {D}{d}{d}-{D}{d}{d}-{d}{d}{d}{d}", "+1 ({D}{d}{d}) {D}{d}{d} {d}{d}{d}{d}", "1-{D}{d}{d}-{D}{d}{d}-{d}{d}{d}{d}", "+1{D}{d}{d}{D}{d}{d}{d}{d}{d}{d}", "{D}{d}{d}{D}{d}{d}{d}{d}{d}{d}",
           "0{d}{d}{d} {d}{d}{d} {d}{d}{d}{d}", "0{d}{d}{d}{d} {d}{d}{d}{d}{d}{d}", "+44 {D}{d}{d}{d} {d}{d}{d}{d}{d}{d}", "+44 (0){D}{d}{d}{d} {d}{d}{d}{d}{d}{d}", "+44 20 {d}{d}{d}{d} {d}{d}{d}{d}"],
    "de": ["0{D}{d}/{d}{d}{d}{d}{d}{d}{d}{d}", "0{D}{d}-{d}{d}{d}{d}{d}-{d}{d}{d}", "(0{D}{d}) {d}{d}{d}{d}{d}-{d}{d}{d}", "+49 (0){D}{d} {d}{d}{d}{d}{d}-{d}{d}{d}", "+49 {D}{d} {d}{d}{d}{d}{d} {d}{d}{d}", "0049 {D}{d} {d}{d}{d}{d}{d}{d}{d}{d}", "0{D}{d}{d} {d}{d}{d}{d}{d}{d}{d}", "+49 {D}{d}{d} {d}{d}{d}{d}{d}{d}{d}"],
    "fr": ["0{D} {d}{d} {d}{d} {d}{d} {d}{d}", "0{D}.{d}{d}.{d}{d}.{d}{d}.{d}{d}", "0{D}-{d}{d}-{d}{d}-{d}{d}-{d}{d}", "+33 {D} {d}{d} {d}{d} {d}{d} {d}{d}", "+33 (0){D} {d}{d} {d}{d} {d}{d} {d}{d}", "0033 {D} {d}{d} {d}{d} {d}{d} {d}{d}", "0033 (0){D} {d}{d} {d}{d} {d}{d} {d}{d}", "0{D}{d}{d}{d}{d}{d}{d}{d}{d}"],
    "es": ["{D}{d}{d} {d}{d}{d} {d}{d}{d}", "{D}{d}{d} {d}{d} {d}{d} {d}{d}", "+34 {D}{d}{d} {d}{d}{d} {d}{d}{d}", "+34 {D}{d}{d}-{d}{d}{d}-{d}{d}{d}", "(+34) {D}{d}{d} {d}{d} {d}{d} {d}{d}", "0034 {D}{d}{d} {d}{d}{d} {d}{d}{d}", "{D}{d}{d}-{d}{d}{d}-{d}{d}{d}"],
    "vi": ["0{d}{d}{d} {d}{d}{d} {d}{d}{d}", "0{d}{d}{d}.{d}{d}{d}.{d}{d}{d}", "+84 {d}{d} {d}{d}{d}{d} {d}{d}{d}", "+84-{d}{d}{d}-{d}{d}{d}-{d}{d}{d}", "(0{d}{d}) {d}{d}{d}{d} {d}{d}{d}", "0{d}{d}{d}{d}{d}{d}{d}{d}{d}", "+84 {d}{d}{d} {d}{d}{d} {d}{d}{d}"],
}
IDS = {
    "S": ["{d}{d}{d}-{d}{d}-{d}{d}{d}{d}", "{d}{d}{d}.{d}{d}.{d}{d}{d}{d}", "{d}{d}{d} {d}{d} {d}{d}{d}{d}", "{d}{d}{d}{d}{d}{d}{d}{d}{d}"],
    "N": ["{L}{L}{d}{d}{d}{d}{d}{d}{A}", "{L}{L} {d}{d} {d}{d} {d}{d} {A}", "{l}{l} {d}{d}{d}{d}{d}{d} {a}", "{L}{L} {d}{d}{d}{d}{d}{d} {A}"],
    "P": ["{L}{L}{d}{d}{d}{d}{d}{d}{d}", "{L}{d} {d}{d}{d}{d}{d}{d}", "{L}{d}{d}{d}{d}{d}{d}{d}{d}", "{d}{d}{d}{d}{d}{d}{d}{d}{d}", "{L}{d}{d}{d}{d}{d}{d}{d}"],
    "de": ["{d}{d} {d}{d}{d} {d}{d}{d} {d}{d}{d}", "{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}", "{L}{d}{d}{d}{d}{d}{d}{d}{d}"],
    "fr": ["{D} {d}{d} {d}{d} {d}{d} {d}{d}{d} {d}{d}{d} {d}{d}", "{D}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}", "{D} {d}{d} {d}{d} {d}{d} {d}{d}{d} {d}{d}{d}"],
    "es": ["{d}{d}.{d}{d}{d}.{d}{d}{d}-{L}", "{L}-{d}{d}{d}{d}{d}{d}{d}-{L}", "{d}{d}{d}{d}{d}{d}{d}{d}{L}", "{L}{d}{d}{d}{d}{d}{d}{d}{L}", "{d}{d}{d}{d}{d}{d}{d}{d}-{L}"],
    "vi": ["{d}{d}{d} {d}{d}{d} {d}{d}{d} {d}{d}{d}", "{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}", "{L}{d}{d}{d}{d}{d}{d}{d}", "{d}{d}{d}{d}{d}{d}{d}{d}{d}"],
}
ADDRESSES = {
    "en": ["{n} {P} Road", "{n} {P} Lane", "{n}{L} {P} Hill Drive", "{n} {P} Street, Flat {D}{d}", "Unit {D}, {n} {P} Close", "{n} West {P} Ave., Apt. {D}{d}", "{n} {P} Street", "{n} North {P} St., Apt. {D}", "{n} {P} Avenue", "{n} {P} Court, Suite {D}{d}", "Apt. {D}, {n} {P} Place", "{n} {S} Square", "{n} {P} Blvd"],
    "de": ["{P}weg {n}{b}", "{P}er Str. {n}", "{P}straße {n}", "Am {P}platz {n}", "{P}allee {n}", "{P}gasse {D}{b}", "{P}er Straße {n}", "Im {P} {n}", "{S}platz {n}"],
    "fr": ["{n}, rue de {P}", "{n} boulevard du {P}", "{n} bis, avenue {P}", "{n}, place {P}", "{n} rue de la {P}", "{n} chemin des {P}", "{n}, quai {S}", "{n} allée {P}"],
    "es": ["Avda. {P} {n}, {D}.º {L}", "C/ {P}, {n}", "Calle de {P}, {n}", "Plaza {P}, n.º {n}", "Calle {S}, {n}", "Avenida {P} {n}", "Paseo de {P}, {n}"],
    "vi": ["{n} đường {P}", "{n}/{D}{d} {V} {Y}", "{n} ngõ {D}{d} phố {P}", "{n} phố {P}", "{n} đường {V} {Y}", "{n} {V} {Y}"],
}
NAMES = ["{G} {S}"] * 5 + ["{G} {L}. {S}", "{L}. {S}", "{G} {S}-{S}", "{S}, {G}", "{GU} {SU}", "{G} Mc{S}", "{G} de {S}", "{G} van {S}", "{G} von {S}", "{G} {L}.", "{G} {G} {S}"]

LINES = {
    "en": [
        "Please contact [name|*] at [phone|*].", "Phone: [phone|*]\nEmail: [email|*]", "Dear Mr. [name|*], thank you for your letter about the {W}.", "Mrs [name|*], [address|*], has returned the {W}.",
        "Patient: [name|*], SSN [id_number|*S], phone [phone|*].", "Social security number: [id_number|*S]", "The tenant's national insurance number is [id_number|*N].", "Passport no. [id_number|*P], issued to [name|*].", "Her ID card [id_number|*P] and insurance no. [id_number|*N] were on file.", "ID: [id_number|*P] / [id_number|*N]", "ID [id_number|*N] or [id_number|*S] is needed.", "The visitor showed [id_number|*N] at the gate.",
        "Mail the form to [address|*] or fax [phone|*].", "She moved from [address|*] to [address|*] last year.", "Ship to: [address|*]", "The office at [address|*] closes at noon.", "[name|*] lives at [address|*], next to the school.",
        "Best regards,\n[name|*]", "Thanks, [name|*] ([email|*])", "Kind regards, [name|*] ([address|*])", "Signed by [name|*] on Monday.", "My name is [name|*] and I run the {W}.", "According to [name|*], the {W} was late.", "“The {W} works,” said [name|*] on Friday.", "Present: [name|*], [name|*] and [name|*].",
        "[name|*] and [name|*] signed the {W}.", "Questions? Write to [email|*] or call [phone|*].", "For the {W}, speak to [name|*], [phone|*].", "The author ([email|*]) wrote to [name|*] about the {W}.", "# Author: [name|*] <[email|*]>", "// Maintainer: [name|*] <[email|*]>", "Reviewed-by: [name|*] <[email|*]>", "name=[name|*];mail=[email|*];tel=[phone|*]", "// hotline [phone|*]", "→ [email|*] · [phone|*]", "Contact | [phone|*] | [email|*]", "Reach the office desk on [phone|*] or by mail: [email|*].", "Cell [phone|*], home [phone|*].", "The number of the shop is [phone|*].",
        "The {W} was sold by [name|*], who had lent it to [name|*].", "Prof. [name|*] and Dr. [name|*] reviewed the {W}.", "His file, [id_number|*S], names [name|*] as the owner of [address|*].", "You can reach us on [phone|*] in the morning.", "Bob said that [name|*] would bring the {W}.", "The neighbours gave [name|*] the old {W}.", "In the will it names [name|*] as the heir of [address|*].", "[name|*] repaired the {W} in two days.", "The driver ([email|*]) and [name|*] painted the {W}.", "It was bought by [name|*], who had sold [name|*] the {W}.",
        "The keys are with [name|*]. The {W} is shut.", "The house of [name|*] stands on [address|*].", "He called [name|*] twice about the {W}.", "Enquiries about the {W} go to [name|*], [email|*].",
        "Follow @{w}_{w} and see ticket AB-{d}{d}{d}{d}-{d}{d}{d}{d}.", "Version {D}.{d}{d}.{d} was built on 20{d}{d}-0{D}-1{d} at 05:{d}{d}:{d}{d}.", "ISBN 978-{d}-{d}{d}{d}{d}-{d}{d}{d}{d}-{d} is out of print.", "ISBN {d}-{d}{d}{d}{d}{d}-{d}{d}{d}-{d} covers the {W}.", "Serial number {d}{d}{d}{d}{d}{d}-{d}{d}-{d}{d}{d}{d}, located at 51.{d}{d}{d}{d}, 7.{d}{d}{d}{d}.", "Order no. {d}{d}{d}{d}-{d}{d}{d}{d}{d}{d} was for a {W}.", "Invoice {d}{d}{d}{d}{d}{d}{d}{d} is due.", "From 19{d}{d}–20{d}{d} it sold {D}{d} {d}{d}0 000 copies.",
        "The server 10.{D}{d}.{D}.{d}{d} answered in {D}{d} ms.", "The {S} method was named after the {P} Institute.", "{P} Valley University and the {S} Institute are older than the {W}.", "{P} Street Market opens at 9:{d}{d}.", "© 20{d}{d} {S} Media Ltd. All rights reserved.", "Powered by {P} CMS {D}.{d}", "{P} Bridge crosses the {P} River near {P} Hill.", "Home | About Us | Contact | Privacy Policy", "Home\nProducts\nNews\nContact", "Search\nLogin\nSupport\nAbout", "Accept all | Settings\nArchive\nEvents\nHome", "Advertisement\nSign up for the list\nAdvertisement", "SELECT A FROM B WHERE C IS NOT NULL\nGROUP BY D", "Reply from 192.168.{D}.{D}{d} within {D}{d} ms.", "The gateway {D}{d}{d}.{D}{d}{d}.{d}.{D}{d} is down.", "{d}{d},{d} {D}{d} {d}{d}{d} {D}{d}{d} {d}{d},{d} {D}{d}{d}{d} {d}{d}{d} {D}{d}", "Read More: New {W} in Old Town", "Subscribe Now! Watch Part {D}{d}", "Terms of Use · Site Map", "The Old Town Hall is open. It was May. The Red Cross came.",
        "{D}{d}{d} {d}{d}.{d} {D}{d}{d}{d} 0{d}{d}{d} {D}{d} {d}{d}{d} {D}{d}{d}{d} {d}{d}.{d}", "20{d}{d}-0{D}-1{d} 05:{d}{d}:{d}{d} ERROR [{w}_{w}] id={d}{d}{d}{d}{d}{d} took {D}{d}{d} ms\n20{d}{d}-0{D}-2{d} 06:{d}{d}:{d}{d} INFO ok id={d}{d}{d}{d}{d}{d}", "ref 00-{d}{d}{d}{d}{d}{d}", "[00-{d}{d}{d}{d}{d}{d}] The {W} is open.", "The sum was 1{d}{d} {d}{d}{d} {d}{d}{d} euros in {D}{d} of {D}{d} cases.", "x = {d}{d}{d}{d}{d}{d}{d}{d}; y = {D}{d}{d}.{d}{d}", "{W},{D}{d}{d}{d},{d}{d}.{d},{d}{d}{d}{d}{d}{d}{d}{d}", "Lake {P} and Mount {S} are far from Saint {P}.", "The letter Ж and the Greek letter Ω are on page {D}{d}{d}.", "WARNING: DO NOT OPEN. IT IS HOT.", "Of {D}{d}{d} samples, {D} were lost. Between Monday and Friday nothing moved.",
    ],
    "de": [
        "Bitte wenden Sie sich an [name|*], Tel. [phone|*].", "Telefon: [phone|*], E-Mail: [email|*]", "Sehr geehrte Frau [name|*], vielen Dank für den {N}.", "Herr [name|*], wohnhaft [address|*], hat den {N} abgeholt.", "Steuer-ID: [id_number|*]", "Die Steueridentifikationsnummer [id_number|*] gehört [name|*].", "Ausweisnummer [id_number|*], Tel. [phone|*]",
        "Senden Sie das Paket an [address|*].", "Das Büro liegt in der [address|*] im ersten Stock.", "Unterschrieben: [name|*], [address|*].", "Mit freundlichen Grüßen\n[name|*]", "Mein Name ist [name|*] und ich leite den {N}.", "Laut [name|*] kam der {N} zu spät.", "Nach Angaben von [name|*] ist der {N} fertig.", "Anwesend: [name|*], [name|*] und [name|*].", "Fragen beantwortet [name|*], [email|*].", "Sie erreichen uns unter [phone|*] am Vormittag.", "Der Empfang ist unter [phone|*] zu sprechen.", "Der {N} gehörte [name|*] und [name|*].", "Kontakt: [email|*] · [phone|*]", "Herr Dr. [name|*] und Frau [name|*] prüfen den {N}.",
        "Der alte {N} steht seit {D}{d} Jahren am Neuen Markt.", "Die {P}er Hochschule und das {S} Institut sind geschlossen.", "Bestellnummer {d}{d}{d}{d}-{d}{d}{d}{d}{d}{d}, Rechnung {d}{d}{d}{d}{d}{d}{d}.", "Impressum | Datenschutz | Alle Rechte vorbehalten", "Die Fläche beträgt {D}{d}{d} m² bei {D} °C. Der Große Saal ist offen.", "Lesen Sie auch: Der Neue {N} (20{d}{d})", "In {D}{d} von {D}{d} Fällen blieb der Rote Knopf gedrückt. Jetzt Anmelden.", "Das {S}-Verfahren kostet {D}{d} 000 Euro.", "Die Neue Brücke und der Kleine {N} liegen in Bad {P}.", "Der Wert stieg in {D}{d} von {D}{d} Fällen\nWeitere Artikel", "Teilen: Mail · Drucken\nTeilen", "Auf {D}{d} Metern Höhe lagen {D} Tage Schnee.", "Man nehme {D}{d}{d} Gramm Mehl und {d} Liter Wasser.", "Nach {D}{d} Minuten Fahrt kamen {D}{d} Prozent Rabatt.", "Seit {D}{d} Jahren Alle Rechte vorbehalten. Jetzt den Brief bestellen", "Startseite\nSuche\nKontakt\nAnmelden", "Auf etwa {D}{d} Metern Länge\nLesen Sie auch", "Die Wohnung von [name|*] in der [address|*] ist frei.", "Dort hat [name|*] den {N} gebaut.", "Ausweis [id_number|*], Telefon [phone|*], Post an [email|*].",
    ],
    "fr": [
        "Veuillez contacter [name|*] au [phone|*].", "Téléphone : [phone|*] ; courriel : [email|*].", "Madame [name|*], merci pour votre {N}.", "M. [name|*], demeurant [address|*], a rendu le {N}.", "Numéro de sécurité sociale : [id_number|*]", "Le dossier [id_number|*] de la sécurité sociale est au nom de [name|*].", "Envoyez le colis au [address|*].", "Mme [name|*] habite [address|*].", "Fait à Paris, [name|*], [address|*].", "Cordialement,\n[name|*]", "Je m'appelle [name|*] et je dirige le {N}.", "Selon [name|*], le {N} est en retard.", "D'après [name|*], tout va bien.", "Présents : [name|*], [name|*] et [name|*].", "[name|*] et [name|*] ont signé le {N}.", "Écrivez à [name|*] ([email|*]).", "Vous pouvez nous joindre au [phone|*] le soir.", "Signé : [name|*], [address|*].", "→ [email|*] · [phone|*]",
        "L'Institut {S} et l'Université de {P} sont fermés.", "La facture n° {d}{d}{d}{d}{d}{d}{d} s'élève à {D}{d} 000 euros.", "Mentions légales | Nous contacter | Plan du site", "Lire aussi : Le Nouveau {N} (20{d}{d})", "La surface est de {D}{d}{d} m². Le Grand Palais est ouvert.", "Dans {D}{d} cas sur {D}{d}, le {N} pèse {D}{d}{d} kg.", "La méthode {S} vient du Mont {P}.", "Accueil\nAide\nContact\nBoutique", "Le voisin a prêté le {N} à [name|*] hier.", "[name|*] a réparé le {N} avec [name|*].", "La maison de [name|*] ([address|*]) est vide.", "En continuant, vous acceptez {D}{d}{d} cookies. OK",
    ],
    "es": [
        "Póngase en contacto con [name|*] en el [phone|*].", "Teléfono: [phone|*], correo: [email|*].", "Estimada Sra. [name|*]: gracias por la {N}.", "Don [name|*], con domicilio en [address|*], ha devuelto el {N}.", "DNI: [id_number|*]", "El documento [id_number|*] pertenece a [name|*].", "El NIE [id_number|*] figura a nombre de [name|*].", "Envíe el paquete a [address|*].", "Doña [name|*] vive en [address|*] desde enero.", "Firmado: [name|*], [address|*].", "Un saludo,\n[name|*]", "Me llamo [name|*] y dirijo el {N}.", "Según [name|*], el {N} llegó tarde.", "Asistentes: [name|*], [name|*] y [name|*].", "[name|*] y [name|*] firmaron el {N}.", "Escriba a [name|*] al correo [email|*].", "Puede llamarnos al [phone|*] por la mañana.", "El número del taller es [phone|*].", "El teléfono de la oficina es [phone|*] por la noche.", "→ [email|*] · [phone|*]",
        "El Instituto {S} y la Universidad de {P} están cerrados.", "El pedido {d}{d}{d}{d}-{d}{d}{d}{d}{d}{d} cuesta {D}{d} 000 euros.", "Aviso legal | Política de Privacidad | Mapa del sitio", "Lea también: El Nuevo {N} (20{d}{d})", "La superficie es de {D}{d}{d} m². El Gran Teatro está abierto.", "En {D}{d} de {D}{d} casos el {N} pesa {D}{d}{d} kg.", "El método {S} procede de la Sierra de {P}.", "Inicio\nTienda\nNoticias\nBuscar", "El vecino prestó el {N} a [name|*] ayer.", "[name|*] arregló el {N} con [name|*].", "La casa de [name|*] ([address|*]) está vacía.", "El año {D}{d}{d} fue bueno. Plaza Mayor y Puerta del Sol.",
    ],
    "vi": [
        "Xin liên hệ [name|*] qua số [phone|*].", "Điện thoại: [phone|*]; thư điện tử: [email|*].", "Kính gửi bà [name|*], cảm ơn về {N}.", "Ông [name|*], ngụ tại [address|*], đã trả {N}.", "Số căn cước công dân: [id_number|*]", "CCCD số [id_number|*] cấp cho [name|*].", "Gửi hàng đến số [address|*].", "Chị [name|*] sống ở số [address|*].", "Người ký: [name|*], [address|*].", "Trân trọng,\n[name|*]", "Tôi tên là [name|*] và phụ trách {N}.", "Theo [name|*], {N} đến muộn.", "Có mặt: [name|*], [name|*] và [name|*].", "[name|*] và [name|*] đã ký {N}.", "Bà [name|*] cho biết {N} đã xong.", "Hãy viết cho [name|*] theo địa chỉ [email|*].", "Gọi chúng tôi theo số [phone|*] vào buổi sáng.", "→ [email|*] · [phone|*]",
        "Trường Đại học {P} và Viện {P} đóng cửa.", "Đơn hàng {d}{d}{d}{d}-{d}{d}{d}{d}{d}{d} giá {D}{d}{d} 000 đồng.", "Điều khoản | Bảo mật | Sơ đồ trang", "Xem thêm: Ngôi nhà mới (20{d}{d})", "Diện tích là {D}{d}{d} m². Hồ Gươm rất đẹp.", "Trong {D}{d} trên {D}{d} trường hợp, {N} nặng {D}{d}{d} kg.", "Núi Bà Đen và sông Hồng ở xa Chợ Lớn.", "Có {D}{d}{d} nhánh sông và {D}{d} hồ.", "Đảo {Y} {Y} rộng {D}{d}{d} m².", "Tháp {Y} cao {D}{d} mét. Cầu {Y} {Y} dài {D}{d}{d} m.", "Chùa Một Cột và Hồ Tây {Y} ở phía bắc. Sông {Y} Giang sâu {D} m.", "Đèo {Y} {Y} đóng cửa.",
    ],
}

MAILBOXES = ["info", "o'{w}{w}", "{w}{w}_{d}{d}", "{w}.{w}{w}", "{w}{w}+{w}", "{w}", "{l}{w}{w}", "{w}-{w}"]
HOSTS = ["{w}{w}.com", "{w}{w}.example.net", "mail.{w}{w}-{w}.org", "{w}.co.uk", "{w}{w}.de", "{w}{w}.edu", "{w}.test", "{w}{w}.invalid"]


def sample(copies: int = COPIES, seed: int = SAMPLE_SEED, lines: list[tuple[str, str]] | None = None) -> list[tuple[int, str, str, list[tuple[str, int, int]]]]:
    """(number of the line, language, text, mentions) of every copy of every line."""
    rng = random.Random(seed)
    return [(i, lang, *_fill(line, lang, rng)) for i, (lang, line) in enumerate(lines or all_lines()) for _ in range(copies)]


def all_lines() -> list[tuple[str, str]]:
    return [(lang, line) for lang, lines in LINES.items() for line in lines]


def _fill(line: str, lang: str, rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    text, mentions, at = "", [], 0
    for m in re.finditer(r"\[(\w+)\|\*(\w?)\]", line):
        text += _letters(line[at: m.start()], lang, rng)
        value = _mention(m.group(1), m.group(2), lang, rng)
        mentions.append((m.group(1), len(text), len(text) + len(value)))
        text += value
        at = m.end()
    text += _letters(line[at:], lang, rng)
    lead = rng.choice(["", "", "We were told that the " + rng.choice(WORDS) + " is new. ", "<p>", "<li>", "User: ", "- "])
    if rng.random() < 0.15:  # wrapped lines
        spaces = [i for i, ch in enumerate(text) if ch == " "]
        if spaces:
            i = rng.choice(spaces)
            text = text[:i] + "\n" + text[i + 1:]
    tail = rng.choice(["", "", " The " + rng.choice(WORDS) + " is new.", "\n\nWhy the " + rng.choice(WORDS) + " failed", "</p>", "\nNext page", " Can the " + rng.choice(WORDS) + " wait?"])
    return lead + text + tail, [(k, a + len(lead), b + len(lead)) for k, a, b in mentions]


def _mention(kind: str, which: str, lang: str, rng: random.Random) -> str:
    if kind == "name":
        if lang == "vi":
            family = rng.choice(VI_FAMILY) if rng.random() < 0.6 else _letters("{Y}", lang, rng)
            return f"{family} {rng.choice(VI_MIDDLE)} {rng.choice(VI_GIVEN)}"
        return _letters(rng.choice(NAMES), lang, rng)
    if kind == "email":
        local, host = _letters(rng.choice(MAILBOXES), lang, rng), _letters(rng.choice(HOSTS), lang, rng)
        style = rng.random()
        if style < 0.5:
            return f"{local}@{host}"
        if style < 0.65:
            return f"{local} (at) {host}"
        if style < 0.85:
            return f"{local} [at] {host.replace('.', ' [dot] ')}"
        return f"{local} AT {host.replace('.', ' DOT ')}"
    forms = {"phone": PHONES[lang], "address": ADDRESSES[lang], "id_number": IDS.get(which or lang)}[kind]
    return _letters(rng.choice(forms), lang, rng)


def _letters(form: str, lang: str, rng: random.Random) -> str:
    def syllables(n: int) -> str:
        return "".join(rng.choice(ONSETS) + rng.choice(NUCLEI) + (rng.choice(CODAS) if rng.random() < 0.6 else "") for _ in range(n))

    given = lambda: rng.choice(GIVEN.get(lang, GIVEN["en"]))
    family = lambda: rng.choice(SURNAMES.get(lang, SURNAMES["en"])) if rng.random() < 0.4 else syllables(2).capitalize()
    make = {
        "G": given, "S": family, "P": lambda: syllables(2).capitalize(), "W": lambda: rng.choice(WORDS), "N": lambda: rng.choice(NOUNS.get(lang, WORDS)), "w": lambda: syllables(1),
        "d": lambda: rng.choice("0123456789"), "D": lambda: rng.choice("123456789"), "n": lambda: str(rng.randrange(1, 400)),
        "L": lambda: rng.choice("ABCDEFGHJKLMNPQRSTVWXYZ"), "l": lambda: rng.choice("abcdefghjklmnpqrstvwxyz"), "A": lambda: rng.choice("ABCD"), "a": lambda: rng.choice("abcd"), "b": lambda: rng.choice(["", "", "a", "b"]),
        "GU": lambda: given().upper(), "SU": lambda: family().upper(), "V": lambda: rng.choice(VI_FAMILY), "Y": lambda: rng.choice("ĐTLHKNVQ") + rng.choice("ương àm iêu ậu oàn ưỡn ềnh ữu ạc ội".split()),
    }
    return re.sub(r"\{(\w+)\}", lambda m: make[m.group(1)](), form)
