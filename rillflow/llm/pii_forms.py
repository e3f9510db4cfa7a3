"""Made-up sentences with personal information of many forms, for training the tagger of `pii` beyond one corpus.

Values are drawn from the lists below and from syllables; numbers are random digits in the usual groupings of many countries.
Other things that look alike (places, bodies, ships, catalogue numbers, dates, measures) stand in the sentences too, without a label.
"""

from __future__ import annotations

import random

# Given and family names of many languages, words of places and bodies.
GIVEN = (
    "James Mary Robert Patricia Michael Linda David Susan Thomas Karen Daniel Nancy Paul Laura George Emma Edward Alice Henry Grace Jack Lily Charlie Ruby Arthur Ivy "
    "Hans Ursula Klaus Monika Stefan Heike Jürgen Petra Uwe Birgit Lukas Lena Jean Marie Pierre Françoise Luc Sylvie Antoine Chloé Étienne Manon "
    "José María Juan Ana Luis Lucía Javier Pilar Diego Inés Giovanni Francesca Marco Chiara Paolo Giulia Luca Elena João Beatriz Pedro Catarina "
    "Jan Katarzyna Piotr Agnieszka Ivan Olga Sergei Natalia Dmitri Tatiana Pavel Jana Ondřej Zuzana László Ágnes Mihai Ioana Nikos Eleni Mehmet Ayşe Emre Fatma "
    "Lars Ingrid Nils Astrid Mikko Aino Søren Mette Ahmed Fatima Omar Layla Hassan Zainab Yusuf Noor Rajesh Anjali Vikram Deepa Arjun Kavita Sanjay Meera "
    "Li Mei Jun Xin Hiroshi Yuki Kenji Sakura Min-jun Ji-woo Nguyen Linh Minh Putri Budi Siti Kwame Ama Chinedu Ngozi Tariq Amara Thabo Lerato Moana Tane"
).split()
FAMILY = (
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Jackson Clarke Harris Lewis Baker Carter Mitchell Murphy Kelly Ryan Campbell Stewart "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Dubois Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia Martinez Lopez Sanchez Perez Gomez Fernandez Ruiz Diaz Moreno "
    "Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Silva Santos Ferreira Pereira Oliveira Costa Nowak Kowalski Kaminski Novák Svoboda Ivanov Petrov Smirnov Popov Volkov Papadopoulos Nagy Szabo Popescu Yilmaz Kaya Demir "
    "Hansen Johansen Olsen Larsen Andersson Karlsson Nilsson Virtanen Korhonen Khan Ahmed Hussain Ali Rahman Patel Singh Kumar Sharma Gupta Reddy Iyer Das Chen Wang Li Liu Yang Huang Zhao Tanaka Suzuki Sato Watanabe Kim Park Lee Choi Tran Pham Nguyen Okafor Mensah Diallo Dlamini"
).split()
PLACE = (
    "North South East West New Great Upper Lower Saint Royal National Central City County High Old Grand World Second First Red Green Black White Golden Silver Northern Southern Eastern Western Union Free Open Public General United "
    "Carolina Wales Yorkshire Germany France Spain Paris Berlin Madrid London Vienna River Lake Mountain Valley Island Bay Sea Ocean Bridge Castle Abbey Cathedral Church Museum Library University College School Hospital Station Railway Company Society Council Court Party Army Navy Bank League Cup Championship Empire Republic Kingdom Province District Region Parliament Ministry Institute Academy Orchestra Theatre Festival Press Times Review"
).split()
WORDS = (
    "the of and to in a is was for on that by with as from at it were be has had or which this an also not are their after first its but two one new during later who when time year most other work made between city part through used known early group area can over under house water near "
    "der die und das in von mit den des wurde im als auf ist ein für sich auch bei nach zum la le et de les des en dans une est par sur au pour qui plus el los del que se por con una para su fue más como"
).split()
_SOUND = [a + b for a in "b c d f g h j k l m n p r s t v w z br ch dr kl sh st th tr".split() for b in "a e i o u ai ee ou".split()]
_TLD = "com org net edu gov de fr es it co.uk ac.uk com.br nl se no pl io eu ca com.au in jp ch at be info"
_WAY = "Street Road Avenue Lane Drive Court Way Terrace Place Boulevard Close Square Row Crescent Gardens Hill Ave Ave. St St. Rd Rd. Blvd Dr Ln Ct"


def made(r: random.Random, n: int | None = None) -> str:
    return ("".join(r.choice(_SOUND) for _ in range(n or r.choice((2, 2, 3)))) + r.choice(("", "", "n", "s", "r", "l", "tt", "ck"))).capitalize()


def digits(r: random.Random, form: str) -> str:
    """`#` is a digit, `9` one from 1 to 9, `@` a capital letter."""
    return "".join(r.choice("0123456789") if c == "#" else r.choice("123456789") if c == "9" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else c for c in form)


def name(r: random.Random) -> str:
    given = r.choice(GIVEN) if r.random() < 0.7 else made(r, 2)
    family = r.choice(FAMILY) if r.random() < 0.45 else made(r)
    kind = r.random()
    if kind < 0.08:
        family = r.choice(("O'", "O’", "D'", "Mc", "Mac", "Fitz")) + family
    elif kind < 0.16:
        family = f"{family}-{r.choice(FAMILY) if r.random() < 0.5 else made(r)}"
    elif kind < 0.22:
        family = f"{r.choice(('van', 'von', 'de', 'della', 'al', 'der', 'du', 'la', 'di', 'el', 'bin'))} {family}"
    if r.random() < 0.1:
        given = f"{given}-{r.choice(GIVEN)}"
    if r.random() < 0.15:
        given = f"{given} {r.choice('ABCDEFGHJKLMNPRST')}."
    out = f"{family}, {given}" if r.random() < 0.1 else f"{given} {family}"
    return out.upper() if r.random() < 0.05 else out


def email(r: random.Random) -> str:
    a, b = (r.choice(GIVEN) if r.random() < 0.5 else made(r)).lower(), (r.choice(FAMILY) if r.random() < 0.5 else made(r)).lower()
    local = r.choice((f"{a}.{b}", f"{a[0]}.{b}", f"{a}{r.randint(1, 2020)}", f"{a}_{b}", f"{a}-{b}", f"{a}.{b[0]}", f"{b}", f"{a}+{r.choice(WORDS)}", r.choice(("info", "office", "press", "contact", "webmaster", "sales"))))
    host = r.choice((made(r).lower(), f"mail.{made(r).lower()}", f"{made(r).lower()}-{made(r).lower()}", "gmail", "yahoo", "outlook", "posteo"))
    at, dot = r.choice((("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), ("&#64;", ".")))
    domain = f"{host}.{r.choice(_TLD.split())}".replace(".", dot)
    return "".join(c for c in local if c.isalnum() or c in "._+-") + at + domain


_PHONES = (
    "(9##) 9##-####|9##-9##-####|9##.9##.####|+1 9## 9## ####|+1-9##-9##-####|1-9##-9##-####|07### ######|07###  ######|0#### ######|0## #### ####|+44 7### ######|+44 (0)## #### ####|+44 ## #### ####|0## ########|0##/#######|0#### / #####|"
    "+49 9## #######|+49 (0)9## ######|+49-9##-#######|0# ## ## ## ##|+33 9 ## ## ## ##|06.##.##.##.##|+34 9## ## ## ##|9## ## ## ##|9## ### ###|+39 0# #### ####|+31 6 ########|+41 ## ### ## ##|+91 9#### #####|+61 4## ### ###|+81 9#-####-####|+86 1## #### ####|+7 9## ###-##-##|+55 ## 9####-####|00## ## ### ####|555-####"
).split("|")
_IDS = "###-##-####|### ## ####|@@ ## ## ## @|@@######@|@#######|@@#######|########@|########-@|9 ## ## ## ### ### ##|9##########|## ### ### ###|######-####|######-#####|###.###.###-##|#### #### ####|@##@##@##|@ ### ### ###|##########|###########".split("|")


def address(r: random.Random) -> str:
    n, kind = str(r.choice((r.randint(1, 99), r.randint(100, 999), r.randint(1000, 9999)))), r.random()
    if r.random() < 0.15:
        n += r.choice(("A", "B", "C", "a", "b"))
    x = r.choice(FAMILY) if r.random() < 0.3 else made(r)
    if kind < 0.5:
        side = r.choice(("", "", "", "North ", "South ", "East ", "W. ", "N. "))
        tail = r.choice(("", "", "", "", " NW", " SE", f", Apt {r.randint(1, 40)}", f", Flat {r.randint(1, 9)}", f" #{r.randint(1, 40)}", f", Unit {r.randint(1, 20)}", f", Suite {r.randint(1, 900)}"))
        lead = r.choice(("", "", "", "", f"Flat {r.randint(1, 30)}, ", f"Apt {r.randint(1, 30)}, "))
        return f"{lead}{n} {side}{x}{' ' + made(r) if r.random() < 0.1 else ''} {r.choice(_WAY.split())}{tail}".replace(".,", ",")
    if kind < 0.65:
        return r.choice((f"{x}straße {n}", f"{x}gasse {n}", f"{x} Straße {n}", f"{x}er Weg {n}", f"{x}platz {n}", f"Am {x}weg {n}", f"{x}str. {n}", f"{x}allee {n}"))
    if kind < 0.82:
        way = r.choice(("rue", "avenue", "boulevard", "place", "impasse", "chemin", "quai", "allée"))
        return f"{n}{r.choice(('', '', ' bis', ' ter'))}{r.choice((' ', ', '))}{way} {r.choice(('', 'de ', 'du ', 'des ', 'de la '))}{x}"
    if kind < 0.92:
        return r.choice((f"Calle {x} {n}", f"C/ {x} {n}", f"Calle de {x}, {n}", f"Avenida {x} {n}", f"Plaza de {x}, {n}", f"Paseo {x} {n}", f"Calle {x}, {n}, {r.randint(1, 9)}º {r.choice('ABC')}"))
    return r.choice((f"Via {x} {n}", f"Piazza {x} {n}", f"Via {x}, {n}", f"Rua {x} {n}", f"Rua {x}, {n}"))


_BEFORE = {
    "name": "by |written by |signed by |contact |ask for |Dear |Mr |Mrs |Dr |Professor |said |met |with |daughter of |author: |born |Herr |Frau |M. |Mme |don |señora |editor |, |and |und |et |y |* |[[|'''|# ".split("|"),
    "email": "email |e-mail: |write to |mail |contact: |Mail an |courriel : |correo: |<|(|, |at |mailto:".split("|"),
    "phone": "call |tel. |Tel.: |phone |phone: |ring |mobile |fax |on |Telefon |tél. : |teléfono |T: |(tel |text me at |, |number is |reach me at ".split("|"),
    "id_number": "SSN |passport no. |ID number |national insurance |identity card |NI number |Personalausweis |Reisepass |DNI |sécu |Steuer-ID |licence |ID: |social security number |no. ".split("|"),
    "street_address": "at |lives at |address: |visit |sent to |to |Send it to |deliver to |moved to |home, |wohnt |Adresse: |habite |adresse : |vive en |domicilio: |in |of |, ".split("|"),
}


def other(r: random.Random) -> str:
    """Something without a label that looks a little alike."""
    k = r.random()
    if k < 0.4:
        return " ".join(r.choice(PLACE) if r.random() < 0.75 else made(r) for _ in range(r.choice((2, 2, 3))))
    if k < 0.5:
        return f"{r.choice(('the ship', 'the SS', 'HMS', 'das Schiff', 'le navire'))} {made(r)} {r.choice(PLACE)}"
    return r.choice(
        (digits(r, "ISBN 97#-#-####-####-#"), digits(r, "oldid=#########"), digits(r, "catalogue no. ##-####-##"), digits(r, "19##-##-##"), digits(r, "9,###,###"), digits(r, "18##–19##"), digits(r, "##.####, ##.####"), digits(r, "No. ####/##"), digits(r, "inventory ####.###.##"), digits(r, "hull number ####-####-##"),
         f"{r.randint(2, 99)} {r.choice(WORDS)}", f"{r.randint(1000, 2020)} {made(r)}", f"{made(r)} & Sons", f"{made(r)} Inc.", f"{made(r)} {r.choice(_WAY.split())}", f"User:{made(r)}", f"{digits(r, '9##')} {r.choice(PLACE)} {r.choice(PLACE)}", f"{made(r)} in {r.choice(PLACE)}", digits(r, "doi:10.####/######"))
    )


_MAKE = {"name": name, "email": email, "phone": lambda r: digits(r, r.choice(_PHONES)) + (digits(r, r.choice((" ext. ##", " x###", " ext ###"))) if r.random() < 0.06 else ""), "id_number": lambda r: digits(r, r.choice(_IDS)), "street_address": address}


def sentence(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A piece of text and its spans (start, end, type)."""
    out, spans, n = [], [], 0

    def put(text: str, kind: str | None = None) -> None:
        nonlocal n
        if kind:
            spans.append((n, n + len(text), kind))
        out.append(text)
        n += len(text)

    put("".join(f"{r.choice(WORDS)} " for _ in range(r.randrange(9))))
    for _ in range(r.choice((1, 1, 1, 2))):
        if r.random() < 0.6:
            kind = r.choice(("name", "name", "name", "name", "email", "phone", "id_number", "street_address", "street_address"))
            put(r.choice(_BEFORE[kind]) if r.random() < 0.85 or kind == "id_number" else "")
            put(_MAKE[kind](r), kind)
            if kind == "street_address" and r.random() < 0.4:
                put(f"{r.choice((', ', ' in ', ', ', ' '))}{digits(r, '##### ') if r.random() < 0.3 else ''}{made(r) if r.random() < 0.6 else r.choice(PLACE)}")
        else:
            put(other(r))
        put(r.choice((". ", ", ", " ", "; ", ") ", "\n", "]] ", "''' ")))
        put("".join(f"{r.choice(WORDS)} " for _ in range(r.randrange(7))))
    text = "".join(out)
    return text, spans
