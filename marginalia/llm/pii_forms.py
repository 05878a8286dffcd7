"""Written forms of personal information, to teach the tagger: generators of values and loose marks for training rows.

Both speak of formats that are public knowledge (numbering plans, tax and identity numbers, postal conventions) and serve
training only; what is found in a text is decided by the network. Values are made, not collected: every digit is drawn.
"""

from __future__ import annotations

import re

import numpy as np

Span = tuple[int, int, str]
_UPPER, _ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHJKLMNPRTUVWXYZ0123456789"

# Shapes of values. 9 draws a digit, 8 a digit from 1, A a letter, N a letter or digit, other characters stand for themselves.
PHONES = """+44 8999 999999|+44 89 9999 9999|+44 (0)89 9999 9999|0899 999 9999|08999 999 999|08999 999999|(08999) 999999|+1 899 899 9999|+1-899-899-9999|+1 (899) 899-9999|(899) 899-9999|899-899-9999|899.899.9999
899 899 9999|1-899-899-9999|1 899 899 9999|899-9999|1899899 9999|18998999999|8998999999|+49 89 9999999|+49 (0)89 99999999|+49 8999 9999999|089 9999999|089/99999-999|089/9999999|08999/999999|0899 8 99999999|+498999999999|0899-9999999
+33 8 99 99 99 99|08 99 99 99 99|08.99.99.99.99|08-99-99-99-99|0899999999|+33899999999|+34 899 99 99 99|899 99 99 99|+34 899 999 999|899 999 999|+34899999999|+39 089 999 9999|+39 899 9999999|089 9999999|+31 8 99999999|+31 89 999 9999
+31 (0)8 9999 9999|08-99999999|08 99999999|+48 899 999 999|+46 89 999 99 99|089-999 99 99|+351 899 999 999|+7 (899) 999-99-99|+7 899 999 99 99|8 (899) 999-99-99|+41 89 999 99 99|+55 89 99999-9999|+91 89999 99999|0044 89 9999 9999|0049 899 9999999|+353 8 999 9999|+61 8 9999 9999""".replace("\n", "|").split("|")
ID_NUMBERS = """899-99-9999|899 99 9999|AA 99 99 99 A|AA999999A|AA 999999 A|8 99 99 99 999 999 99|899999999999999|8 99 99 9A 999 999 99|89 999 999 999|89999999999|899 999 999|899999999|89999999|A99999999|A9999999|AA9999999|A9A99999A|A99A99A99|NNNNNNNNN9
99999999A|99999999-A|99.999.999-A|X9999999A|Y-9999999-A|Z9999999A|AAAAAA99A99A999A|999999999|9999.99.999|89999999999|999999-9999|19999999-9999|20999999-9999|899.9999.9999.99|999.999.999-99|9999 9999 9999|99 AA 99999|99AA99999|AAA 999999|AAA999999|99/999/99999|899/9999/9999|A9999-99999-99999|AA999999 A
8.99.99.99.999.999.99|A99 999 999|AA 9999999|999 999 999|9 999 999 999|AANN9999A""".replace("\n", "|").split("|")
EXTENSIONS = [" ext. 999", " ext 99", " x999", " extension 99", " Durchwahl 99", " poste 999", " App. 99", " ext. 9999", "-99"]

# Words of postal addresses.
STREETS_EN = "Street Road Avenue Lane Close Court Drive Way Place Terrace Crescent Gardens Square Hill Row Mews Boulevard Grove Walk Rise Park View St St. Rd Rd. Ave Ave. Ln Ln. Dr Dr. Blvd Ct Pl Sq Cres Pkwy Hwy".split()
NAMES_EN = "Alder Maple Church Station Mill Harbour Queen's King Victoria Albert Orchard Meadow Chapel Bridge Castle High Long North Green Cherry Willow Ferry Market Bishop Linden Baker Cooper Park Main Second Fifth Lake River Old Wharf Priory Windmill Rose Elm Birch Garrison Hollow Sunset Lincoln Jefferson Cedar".split()
NAMES_EN += ["Saint John's", "St. Mary's", "Long Meadow", "Upper Mill", "Martin Luther King", "Great Western", "Two Rivers", "King George", "Church Hill", "Little London"]
WAYS_FR = ["rue", "avenue", "boulevard", "place", "impasse", "allée", "chemin", "quai", "route", "cours", "Rue", "Avenue", "Place", "bd"]
NAMES_FR = ["de la République", "Victor Hugo", "des Lilas", "du Moulin", "de l'Église", "Jean Jaurès", "des Écoles", "du Vieux Pont", "de la Gare", "Pasteur", "Saint-Michel", "d'Alsace", "du Général Leclerc", "des Tanneurs", "de Provence", "Gambetta"]
STEMS_DE = ["Linden", "Bahnhof", "Haupt", "Garten", "Schiller", "Goethe", "Kirch", "Mühlen", "Wiesen", "Berg", "Rosen", "Birken", "Schul", "Wald", "Ufer", "Hafen", "Dorf", "Brunnen"]
ENDS_DE = ["straße", "strasse", "weg", "gasse", "allee", "ring", "damm", "ufer", "platz", "str.", "steig"]
WHOLE_DE = ["Am Alten Markt", "An der Mühle", "Im Winkel", "Zum Sportplatz", "Am Bahndamm", "Unter den Linden", "Auf der Heide", "Am Wall", "Zur Alten Schmiede", "Lange Straße", "Hinter der Kirche"]
WAYS_ES = ["Calle", "calle", "Avenida", "Avda.", "Plaza", "Paseo", "C/", "C.", "Camino", "Ronda", "Travesía"]
NAMES_ES = ["Mayor", "de Alcalá", "del Sol", "de la Paz", "San Martín", "de los Olivos", "Gran Vía", "del Pintor Sorolla", "de las Flores", "Real", "de Cervantes", "del Carmen", "del Molino Viejo"]
WAYS_IT = ["Via", "via", "Viale", "Piazza", "Corso", "Largo", "Vicolo"]
NAMES_IT = ["Roma", "Garibaldi", "dei Mille", "della Repubblica", "Dante Alighieri", "San Marco", "del Corso", "Vittorio Emanuele"]
STEMS_NL = ["Kerk", "Dorps", "Molen", "School", "Julia", "Prinsen", "Linden", "Noorder"]
TOWNS = """Norwood Ashby Kettering Milton Redmere Halden Westbrook Fairview Springfield Riverton Lakewood Oakdale Port Ellen|Upper Slaughter|Little Haven|New Haven|Saint Albans|East Linton|Great Yarrow|Kingston upon Hull|Herne Bay|Long Island|
Salt Lake City|Stratford|Bad Homburg|Berlin|Köln|Würzburg|Neustadt an der Weinstraße|Lyon|Saint-Denis|La Rochelle|Aix-en-Provence|Sevilla|San Sebastián|Las Palmas|Torrevieja|Bologna|Reggio Emilia|Utrecht|Den Haag|Hampstead Heath|Vieux Boucau""".replace("\n", "")
TOWNS = [t for part in TOWNS.split("|") for t in (part.split() if part.startswith("Norwood") else [part]) if t]
REGIONS_US = "AL AZ CA CO FL GA IL IN KY MA MD ME MI MN MO NC NJ NM NV NY OH OR PA TN TX UT VA VT WA WI".split()
AREAS_UK = "AB B BS CF E EC EH G GL HR L LS M N NE NR OX PE S SE SW TW W WC YO".split()
BOXES = ["P.O. Box", "PO Box", "P. O. Box", "Post Office Box", "Postfach", "BP", "B.P.", "Boîte postale", "Apartado de Correos", "Apartado", "Apdo.", "Postbus", "Casella Postale"]
HOSTS = "mail post inbox letters example journal home work office school family north garden webmail fastpost mymail cable lists news uni town".split()
ENDINGS = "com org net de fr es it nl pl se co.uk io info eu me test example edu gov email co.jp com.br ch at".split()

# Sentences round a value, {} for it, by kind; the last group has values that identify nobody.
AROUND = {
    "email": """Write to {} and ask.|my new address is {}.|mailto:{}|e-mail: {}|{} is the one that works|Send it to {}, please|Bitte an {} schreiben|Escríbeme a {} cuando puedas|Mon adresse: {}|contact {} / |(reach me under {})|From: {}\n|cc {}; reply soon""",
    "phone": """Call {} tonight.|call me on {}|New number: {}|Tel. {}|phone {}, not before nine|rang from {} twice|Handy: {}|Meine Nummer ist {}|mon numéro est le {}|su número es {}|mobile {} / |my phone is {}.|fax {}|text me at {}|WhatsApp {}|T: {}\n|try {} in the evening|{} is the landline""",
    "id_number": """My passport number is {}.|passport {} expires soon|SSN {}|social security number {}|Tax reference {}, keep it|Steuernummer {}|Steuer-ID: {}|NI number {}|Insurance card: {}|Versicherungsnummer {}|numéro de sécurité sociale {}|DNI {}|mi número de identidad es {}|ID card no. {}|Ausweis {}
they asked for my number ({})|quote {} in every call|national insurance {} on the letter|identity card {}|codice fiscale {}|BSN {}|PESEL {}|personnummer {}|driving licence {}|my tax number, {}, was wrong|health insurance {}|TIN {}|CPF {}""".replace("\n", "|"),
    "street_address": """We live at {}.|send it to {}|The parcel goes to {}|moved to {} in May|Address: {}\n|Die Wohnung liegt in der {}|wohnt {}, zweiter Stock links|J'habite {}|au {}, près du parc|Vivo en {}|vive en {} desde hace años|the house at {} is sold|{}, that is where she grew up|lives at {} now|meet me at {} tomorrow|return to {}|viewed a house, {}, too small|home {}""",
    "": """order {O} arrived|invoice {O}|ordered ISBN {B} at last.|ISBN {B}|the map says {c}, {c}|lost {s} on Monday|score {s}|it cost {m} in total|at {t} on track {d}|@ {t} with {d} others|release {v}|room {d}, {d}th floor|finished in {h}|tracking {O}|part number {O}|model {O}|{y}-{y} was a bad winter|on {y}-{e}-{e}|{e}/{e}/{y}|{e}.{e}.{y}|ticket {O}|line {d} of the file|about {g} people|flight {f}
raised {g} for the roof|postcode lottery, {d} times|the code on the box says {O}|the meter reads {g}|{m} EUR|won {d} of {d} games at home|chapter {d}, page {d}|bus {d} to the station at {t}|we walked {d} miles down the hill|I saw the road works at {t}|serial {O}|Bestellung {O}|commande {O}|pedido {O}|the box {d} of {d} was empty|{d} way points|row {d}, seat {d}A""".replace("\n", "|"),
}
AROUND = {kind: lines.split("|") for kind, lines in AROUND.items()}


class Forms:
    """Draws values of each kind; ``held`` names shapes never drawn, for tests on formats that were not taught."""

    def __init__(self, seed: int, held: tuple[str, ...] = ()) -> None:
        self.r = np.random.default_rng(seed)
        self.phones, self.numbers = [p for p in PHONES if p not in held], [p for p in ID_NUMBERS if p not in held]

    def pick(self, options):  # noqa: ANN001, ANN201
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def fill(self, shape: str) -> str:
        d = lambda a, b: str(int(self.r.integers(a, b)))
        return "".join(d(0, 10) if c == "9" else d(1, 10) if c == "8" else self.pick(_UPPER) if c == "A" else self.pick(_ALNUM) if c == "N" else c for c in shape)

    def phone(self) -> str:
        shape = self.pick(self.phones)
        # Separators are used as people like them.
        if self.chance(0.2) and shape.count(" ") > 1 and "(" not in shape:
            shape = shape.replace(" ", self.pick("-./")) if self.chance(0.7) else shape.replace(" ", "")
        return self.fill(shape) + (self.fill(self.pick(EXTENSIONS[:-1])) if self.chance(0.12) else "")

    def id_number(self) -> str:
        return self.fill(self.pick(self.numbers))

    def email(self) -> str:
        word = lambda: self.pick([self.pick(HOSTS), "".join(self.pick(["an", "ber", "co", "dal", "el", "fen", "gar", "ho", "ira", "jo", "kel", "lu", "mor", "nov", "or", "pra", "ri", "sa", "tor", "ul", "ves", "wy", "zin"]) for _ in range(int(self.r.integers(1, 4))))])
        tail = lambda: self.pick(["", "", "", self.fill("9"), self.fill("99"), "_" + self.fill("99"), self.fill("1999"), self.fill("2009"), "+" + self.pick(HOSTS), "-" + word()])
        local = self.pick([word(), f"{word()}.{word()}", f"{word()[:1]}.{word()}", f"{word()}_{word()}", f"{word()}{word()}"]) + tail()
        parts = [*([word()] if self.chance(0.3) else []), self.pick([word(), f"{word()}-{word()}", f"{word()}"]), *self.pick(ENDINGS).split(".")]
        if self.chance(0.55):
            out = f"{local}@{'.'.join(parts)}"
        else:
            at, dot = self.pick([(" [at] ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), (" @ ", "."), ("[at]", "."), (" {at} ", "."), (" (at) ", "."), ("{at}", "{dot}"), (" AT ", " DOT "), ("[at]", "[dot]")])
            out = f"{local}{at}{dot.join(parts)}"
        return out.upper() if self.chance(0.06) else out.title() if self.chance(0.05) else out

    def street_address(self) -> str:
        n = str(int(self.r.integers(1, 10 ** int(self.r.integers(1, 5)))))
        town, kind = self.pick(TOWNS), int(self.r.integers(0, 8))
        uk = lambda: f"{self.pick(AREAS_UK)}{self.fill(self.pick(['8', '89', '8A']))} {self.fill('9AA')}"
        if kind <= 2:
            street = f"{self.pick(NAMES_EN)} {self.pick(STREETS_EN)}"
            street = street.lower() if self.chance(0.25) else street
            if self.chance(0.5):  # British or plain
                out = f"{n}{self.pick(['', '', '', 'a', 'b', 'B'])} {street}"
                out = f"{self.pick(['Flat', 'Apt', 'Unit', 'Suite', 'Apartment'])} {self.pick([self.fill('8'), self.fill('89'), self.fill('8A'), self.fill('89A')])}, {out}" if self.chance(0.3) else out
                out += f", {self.pick(['Flat', 'Apt', 'Unit', 'Apt.', 'No.'])} {self.fill(self.pick(['8', '89A', '8A', '89']))}" if self.chance(0.2) and not out.startswith(("F", "A", "U", "S")) else ""
                return out + (f", {town}" + (f"{self.pick([' ', ', '])}{uk()}" if self.chance(0.6) else "") if self.chance(0.6) else f" {uk()}" if self.chance(0.1) else "")
            out = f"{n} {self.pick(['', '', 'N. ', 'E. ', 'W ', 'SW ', 'S. '])}{street}"
            out += f", {self.pick(['Apt', 'Unit', 'Suite', '#'])} {self.fill(self.pick(['89', '8A', '899']))}" if self.chance(0.2) else ""
            return out + (f", {town}, {self.pick(REGIONS_US)} {self.fill('99999')}" + ("-" + self.fill("9999") if self.chance(0.1) else "") if self.chance(0.55) else f", {town}" if self.chance(0.4) else "")
        if kind == 3:
            out = f"{n}{self.pick(['', '', ' bis', ' ter'])}{self.pick([' ', ', '])}{self.pick(WAYS_FR)} {self.pick(NAMES_FR)}"
            return out + (f", {self.fill('99999')} {town}" if self.chance(0.5) else f", {town}" if self.chance(0.2) else "")
        if kind == 4:
            street = self.pick(WHOLE_DE) if self.chance(0.3) else self.pick(STEMS_DE) + self.pick(ENDS_DE)
            out = f"{street} {n}{self.pick(['', '', 'a', 'b', ' c'])}"
            return out + (f", {self.fill('99999')} {town}" if self.chance(0.5) else f", {town}" if self.chance(0.15) else "")
        if kind == 5:
            out = f"{self.pick(WAYS_ES)}{self.pick([' ', ' ', ''])}".rstrip() + f" {self.pick(NAMES_ES)}, {n}"
            out = out.replace("C/ ", "C/") if self.chance(0.4) else out
            out += f", {self.fill('8')}º {self.pick('ABCD')}" if self.chance(0.35) else ""
            return out + (f", {self.fill('99999')} {town}" if self.chance(0.4) else "")
        if kind == 6:
            if self.chance(0.5):
                return f"{self.pick(WAYS_IT)} {self.pick(NAMES_IT)}{self.pick([', ', ' '])}{n}" + (f", {self.fill('99999')} {town}" if self.chance(0.5) else "")
            return f"{self.pick(STEMS_NL)}{self.pick(['straat', 'weg', 'laan', 'gracht', 'plein', 'dijk'])} {n}" + (f", {self.fill('8999')} {self.fill('AA')} {town}" if self.chance(0.5) else "")
        return f"{self.pick(BOXES)} {n}" + (f", {self.pick([town, self.fill('99999') + ' ' + town, town + ' ' + uk(), town + ', ' + self.pick(REGIONS_US) + ' ' + self.fill('99999')])}" if self.chance(0.7) else "")

    def nothing(self) -> str:
        """A passage with figures that identify nobody."""
        two = lambda: self.fill(self.pick(["8", "89"]))
        shapes = {
            "O": lambda: self.fill(self.pick(["A9999-9", "9999-9999-99", "9999-99", "AAA-99999", "#99999", "99999", "A999", "AA-9999-9", "999-999", "9999-A"])),
            "B": lambda: self.fill(self.pick(["978-9-99-999999-9", "978-9-9999-9999-9", "9789999999999", "9-999-99999-9"])), "c": lambda: f"{two()}.{self.fill('9999')}", "s": lambda: self.fill(self.pick(["899-899", "89-89", "8-8"])),
            "m": lambda: self.fill(self.pick(["8,999.99", "89.99", "8.999,99", "899.99", "8 999,99"])), "t": lambda: self.fill(self.pick(["19:59", "8.39", "19.49"])), "d": two, "v": lambda: f"{two()}.{two()}.{two()}", "h": lambda: self.fill("8:59:59"),
            "y": lambda: self.fill(self.pick(["1989", "2009", "1999"])), "e": lambda: f"{int(self.r.integers(1, 13)):02d}", "g": lambda: self.fill(self.pick(["89 999", "8,999", "8999", "89,999", "8 999 999"])), "f": lambda: self.fill(self.pick(["AA 999", "AA9999"])),
        }
        return re.sub(r"\{(\w)\}", lambda m: shapes[m.group(1)](), self.pick(AROUND[""]))

    def value(self, kind: str) -> str:
        return getattr(self, kind)()

    def passage(self) -> tuple[str, list[Span]]:
        """A sentence with a value in it, or with figures only."""
        if self.chance(0.3):
            return self.nothing(), []
        kind = self.pick(["email", "phone", "id_number", "street_address"])
        line, value = self.pick(AROUND[kind]), self.value(kind)
        at = line.index("{}")
        return line.replace("{}", value), [(at, at + len(value), kind)]


# Loose marks of the training rows: shapes of the kinds, longest reading first. They teach; they decide nothing in a text that is read.
_TOWN = r"(?:\s(?:of\s|upon\s|an der\s)?(?!ZZ\b|[A-Z]{2}\s?\d)[A-ZÀ-Þ][\wÀ-ÿ'’-]+){1,2}"
_POSTCODE = r"(?:[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5})"
_AFTER = rf"(?:,\s(?:(?:Apt|Flat|Unit|Suite)\.?\s\w+|No\.?\s?\d+))?(?:,\s\d{{1,2}}º\s?\w+)?(?:,(?:\s\d{{5}})?{_TOWN}(?:,?\s{_POSTCODE})?|,\s{_POSTCODE})?"
_WAY = r"(?:(?:avenue|street|road|lane|court|close|crescent|drive|terrace|boulevard|way|place|square|gardens|row|mews|hill)\b|(?:ave|st|rd|ln|ct|dr|blvd|cres|terr|pl|sq)\b\.?)"
MARKS = [
    ("email", r"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*(?:\s?(?:@|\(at\)|\[at\]|\{at\})\s?(?:[A-Za-z0-9-]+\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|dot\s)\s?)+|\sat\s(?:[A-Za-z0-9-]+\s(?:dot)\s)+)[A-Za-z]{2,}(?![\w@])"),
    ("street_address", rf"(?:(?:Flat|Apt|Unit)\s\w+,\s)?(?<![\w.,:-])\d{{1,5}}(?:\s?(?:bis|ter)|[a-d])?,?\s(?:[NSEW]\.?\s)?(?:[A-ZÀ-Þa-zà-ÿ][\wÀ-ÿ'’]+\s){{1,3}}?(?i:{_WAY}){_AFTER}"),
    ("street_address", rf"\b\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?i:rue|avenue|impasse|allée|place|boulevard|chemin|quai)\s(?:(?:de|du|des|la|le|les)\s|d['’]|l['’])*[\wÀ-ÿ'’-]+(?:\s[A-ZÀ-Þ][\wÀ-ÿ'’-]+)*{_AFTER}"),
    ("street_address", rf"\b(?:[A-ZÄÖÜa-zäöü][\wäöüß]{{2,}}(?i:straße|strasse|weg|gasse|allee|ring|damm|ufer|str\.)|(?:Am|An der|Im|Zum|Zur)\s[A-ZÄÖÜ]\w+(?:\s[A-ZÄÖÜ]\w+)?)\s\d{{1,4}}[a-z]?\b{_AFTER}"),
    ("street_address", rf"(?:(?i:calle|avenida|avda\.?|plaza|paseo|camino)|C/)\s?(?:(?:de|del|la|las|los|el)\s)*[A-ZÀ-Þa-zà-ÿ][\wÀ-ÿ]+(?:\s[A-ZÀ-Þ][\wÀ-ÿ]+)*,?\s\d{{1,4}}{_AFTER}"),
    ("street_address", rf"(?:P\.?\s?O\.?\s?Box|PO\sBox|Post(?:fach|bus)|Apartado(?:\sde\sCorreos)?|B\.?P\.?|Boîte\spostale|Box)\s\d{{1,6}}{_AFTER}"),
    ("id_number", r"(?<![\w-])(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|\d{3}[- ]\d{2}[- ]\d{4}|[12]\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}\s\d{2}|[12]\d{14}|\d{2}\s\d{3}\s\d{3}\s\d{3}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]?|[A-Z]\d[A-Z0-9]\d{5,6}[A-Z]?|[A-Z]\d{7,8})(?![\w-])"),
    ("phone", r"(?<![\w.,-])(?:(?:\+|00)\d{1,3}[\s./-]?(?:\(0\)\s?)?(?:\(?\d{1,5}\)?[\s./-]?){2,6}|\(?0\d{1,4}\)?[\s./-]\d(?:[\d\s./-]{3,11})\d|0\d{9,10}|\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}|\d{3}[.-]\d{4})(?<=\d)(?:\s?(?:ext\.?|extension|x|Durchwahl|poste|Apparat|App\.)\s?\d{1,5})?(?![\w-])"),
    ("bare", r"(?<![\w.,-])\d{9,11}(?![\w-])"),
]
MARKS = [(kind, re.compile(rule)) for kind, rule in MARKS]
#: Words before a bare number that say what it is; the nearest one counts.
CUE = re.compile(r"(?P<phone>\b(?:call|ring|rang|phone|tel|mobile|handy|nummer von|number for|número de|numéro de|anruf)\w*)|(?P<id_number>\b(?:tax|passport|insurance|steuer|ausweis|versicherung|card|tarjeta|form|office|identi|pass|dni|ssn)\w*)", re.I)


def loose_marks(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """(spans, passages that may be either kind): bare numbers are told apart by the words before them, or left open."""
    out: list[Span] = []
    unsure: list[tuple[int, int]] = []
    for kind, rule in MARKS:
        for m in rule.finditer(text):
            if any(a < m.end() and m.start() < b for a, b, _ in out):
                continue
            if kind != "bare":
                out.append((m.start(), m.end(), kind))
                continue
            cues = [c.lastgroup for c in CUE.finditer(text, max(0, m.start() - 60), m.start())]
            if cues:
                out.append((m.start(), m.end(), cues[-1]))
            else:
                unsure.append((m.start(), m.end()))
    return sorted(out), unsure
