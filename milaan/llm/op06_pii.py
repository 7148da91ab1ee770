"""PII: detected entities get keyed surrogates of their own type, gender, script and format.

Detected are e-mail addresses, phone numbers, payment cards (Luhn), IPv4 addresses, IBANs (mod 97), US social security numbers,
and persons: given names of the lists below (English, German, French, Spanish, Russian; any case), with initials and particles,
before a capitalised surname; a title before one; bare surnames of persons of the same text, which get the surname of the nearest
such person before; and such persons all in lower case.  An entity is its normal form (lower case, digits only,
without initials, and so on); however it is written, it is one entity.  Its surrogate is drawn from a keyed hash of kind, normal form and attempt:
digits for digits, letters for letters of the same script, checksums that hold, a given name of the same gender and script,
a feminine surname for a feminine one.  It is written in the format and case that the text used.

All distinct entities of the corpus are one table.  Surrogates are checked against each other and against every real entity of
their kind; the least entity keeps a contested surrogate, the others draw again, until none is left; from the fourth draw on each
is a character longer (an IP's numbers go beyond 255), so there are always free ones.  So two entities never share
a surrogate, no surrogate is somebody's real value, and an entity has one surrogate in all documents.  Given names are mapped by a
keyed permutation of their own list, which is one to one.  Only documents with entities are shuffled.

Defined results: null and empty texts stay as they are; repeated rows get equal texts; overlapping finds count once, the first and
longest wins, but IBANs, social security numbers and cards go, in this order, before the other numbers; where a checksum fails for all digits, shorter ends and later starts
at separators are tried; extra columns are kept.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import prepare, table, text_slices
from milaan.sources.writers import materialized

KEY = "surrogates-1"
FREE_DRAWS = 3  # draws in the shape of the entity; each later one is a character longer, so free values never run out
EQUAL_DRAWS = 256  # so many draws that give the value itself are an error
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "person")

# Common given names by script and gender, and what surnames are made of.
GIVEN = {
    ("latin", "f"): (
        "Mary Patricia Jennifer Elizabeth Barbara Susan Jessica Margaret Katherine Helen Dorothy Amanda Melissa Deborah Stephanie Rebecca Laura Kimberly Angela Nicole Charlotte Victoria Gabriela Francesca "
        "Linda Karen Nancy Lisa Betty Sandra Ashley Donna Emily Carol Michelle Sharon Cynthia Kathleen Amy Shirley Anna Brenda Pamela Emma Samantha Christine Catherine Virginia Rachel Carolyn Janet Maria Heather Diane Ruth Julie Olivia Joyce Kelly Christina Lauren Joan Evelyn Judith Megan Cheryl Hannah Jacqueline Martha Gloria Teresa Sara Sarah Janice Julia Ann Anne Kathryn Sophia Frances Alice Judy Isabella Grace Rose Jane "
        "Ursula Monika Petra Sabine Renate Helga Karin Brigitte Ingrid Erika Claudia Susanne Gisela Elke Birgit Heike Anja Silke Ute Katja Katrin Kerstin Martina Anke Greta Heidi Johanna Lena Lea Leonie Mia Franziska Sabrina Hildegard Gertrud Elisabeth Margarete Christa Jutta Gudrun Angelika Bettina Cornelia Doris Antje Annette Ilse Waltraud Marie Luise "
        "Nathalie Isabelle Sylvie Catherine Françoise Monique Jacqueline Jeanne Hélène Valérie Sandrine Céline Véronique Chantal Aurélie Camille Chloé Léa Manon Inès Juliette Élodie Émilie Amélie Mathilde Pauline Margaux Geneviève Thérèse Madeleine Simone Odile Colette Bernadette Corinne Laurence Florence Martine Brigitte Delphine Virginie Agnès Cécile Béatrice Solène Clémence Zoé Louise Denise Josette Yvette Nadine Élise Lucie "
        "Carmen Josefa Isabel Dolores Pilar Francisca Antonia Mercedes Cristina Lucía Ángela Rosario Juana Raquel Manuela Beatriz Nuria Silvia Rocío Encarnación Montserrat Inmaculada Sofía Paula Alba Irene Marta Lorena Natalia Verónica Concepción Guadalupe Ximena Valentina Mariana Daniela Alejandra Adriana Fernanda Esperanza Consuelo Begoña Rosa Elena Alicia Eva Julia"
    ).split(),
    ("latin", "m"): (
        "James Robert John Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Joshua Kenneth Kevin Brian George Timothy Alexander Wolfgang "
        "Mark Donald Paul Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Frank Raymond Patrick Jack Dennis Jerry Tyler Aaron Adam Henry Nathan Douglas Zachary Peter Kyle Walter Ethan Jeremy Harold Keith Roger Arthur Gerald Carl Lawrence Dylan Bryan Joe Albert Bruce Ralph Oliver Harry Liam Noah Lucas Simon Philip Martin "
        "Hans Jürgen Klaus Günter Günther Helmut Horst Manfred Dieter Heinz Karl Werner Gerhard Bernd Uwe Rainer Stefan Andreas Matthias Jörg Torsten Thorsten Ralf Holger Sven Dirk Jens Kai Lars Florian Sebastian Tobias Felix Moritz Lukas Leon Jonas Max Maximilian Fritz Friedrich Heinrich Otto Hermann Ludwig Rudolf Ernst Johannes Johann Christian Markus Norbert Volker Axel Detlef Gottfried Siegfried Wilhelm Ulrich Reinhard Rolf Kurt Erich Georg Christoph Philipp Marcel "
        "Jean Pierre Jacques Michel André Philippe Bernard Alain Louis François Frédéric Christophe Nicolas Laurent Stéphane Sébastien Thierry Pascal Éric Gérard Guillaume Julien Antoine Mathieu Maxime Étienne Olivier Yves Marc Luc Rémi René Gilles Didier Hervé Bruno Vincent Benoît Jérôme Fabrice Xavier Raphaël Théo Hugo Léo Gabriel Arnaud Cédric Loïc Émile Marcel Lucien Fernand Gaston Serge Claude Denis Henri Joël Noël Cyril "
        "José Antonio Manuel Juan Francisco Javier Carlos Jesús Miguel Ángel Luis Pedro Rafael Alejandro Fernando Sergio Jorge Alberto Álvaro Pablo Diego Adrián Raúl Enrique Ramón Vicente Iván Rubén Óscar Andrés Joaquín Santiago Eduardo Víctor Roberto Jaime Mario Ignacio Marcos Salvador Alfonso Ricardo Emilio Julio Guillermo Gonzalo Mateo Martín Tomás Agustín Esteban Felipe Gustavo Hernán Rodrigo Cristóbal Nicolás Julián Hugo"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Екатерина Светлана Ирина Людмила Юлия Анастасия Дарья Ксения Галина Валентина Вера Надежда Любовь Нина Лариса Алина Полина Софья Виктория Александра Евгения Марина Оксана Тамара".split(),
    ("cyrillic", "m"): "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел Юрий Виктор Олег Игорь Евгений Константин Роман Максим Артём Кирилл Денис Антон Василий Пётр Борис Григорий Георгий Фёдор Степан Никита".split(),
}
GIVEN = {group: list(dict.fromkeys(names)) for group, names in GIVEN.items()}
# These are words as well: as names they begin with a capital.
ALSO_WORDS = set("mark frank grace rose pierre rosa pilar mercedes max sharon joan gary jack carol gloria alba esperanza consuelo rosario salvador ernst marc florence jean claude denise martin angel santiago concepción encarnación dolores вера надежда любовь роман".split())
# In words all in capitals these are no surnames.
NO_SURNAMES = set("and or the of in at is was had has have said with from und oder ist war hat sagte et ou est était dit y o es fue dijo и или был была".split())
TITLES = {t: g for g, ts in {
    "m": "mr mister herr herrn monsieur señor sr господин", "f": "mrs ms miss frau madame mme mademoiselle mlle señora señorita sra srta госпожа", "": "dr doktor doctor docteur prof professor",
}.items() for t in ts.split()}
ALPHABETS = {
    "digit": "0123456789", "latin": "abcdefghijklmnopqrstuvwxyz", "accented": "àáâãäåçèéêëìíîïñòóôõöùúûüý",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ",
    "georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", "thai": "กขคงจชซดตถทนบปผพฟมยรลวสหอ",
    "hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ", "katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후", "cjk": "山水木火土日月天田石金竹花草米雨雪雲風林森川海島江河湖東西南北春夏秋冬青白红黄紫黑光星",
}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст"}

CLASS_OF = {c: k for k, chars in ALPHABETS.items() for c in chars}
NAME_OF: dict[str, tuple[tuple[str, str], int]] = {}
for _group, _names in GIVEN.items():
    for _i, _n in enumerate(_names):
        for _form in (_n, "".join(c for c in unicodedata.normalize("NFD", _n) if "й" in _n.lower() or not unicodedata.combining(c))):  # accents may be left out
            NAME_OF.setdefault(unicodedata.normalize("NFC", _form).lower(), (_group, _i))

ISSUERS = "23456"  # what card numbers begin with

CARD_GROUPS = {(n,) for n in range(13, 20)} | {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1)}  # how cards are written
# The length of an IBAN by country.
IBAN_LENGTH = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
).split()) for c in cs.split(",")}

# The prefilter's: words part at all that is no letter, as the boundaries of PERSON do or finer.
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
RUNS = re.compile(r"[^\W\d_]+|\d+")
# Numbers are looked for in a view of the text of the same length: ASCII for the decimal digits of all scripts, full-width signs, wide spaces.
DECIMAL = {i: unicodedata.decimal(chr(i)) for i in range(128, sys.maxunicode + 1) if chr(i).isdecimal()}
PLAIN = {i: str(d) for i, d in DECIMAL.items()} | dict(zip(map(ord, "＋（）－．\u2010\u2011\u00a0\u2007\u202f\u3000"), "+()-.--    ", strict=True))

# Every pattern takes time in proportion to the text: quantifiers are bounded or possessive, and a run is entered at its start only.
DOMAIN = re.compile(r"[A-Za-z0-9.-]*+")
TOP_LABEL = re.compile(r"[A-Za-z]{2,}+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
CARD = re.compile(r"(?<![0-9])(?:[0-9]++(?:[ -][0-9]++)++|[0-9]{13,19}+(?![0-9]))")
GROUP = re.compile(r"[0-9]+")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
LETTER, GAP = r"[^\W\d_][\u0300-\u036f]*", r"[^\S\r\n]+"
SURNAME = rf"(?:{LETTER}['’])?(?:{LETTER}){{2,}}(?:[-'’](?:{LETTER}){{2,}})*"
NAME_WORD = re.compile(rf"(?<!\w)(?:{LETTER})++")
# What follows a given name or a title: initials, particles, and the surname.
AFTER = re.compile(
    rf"(?P<initials>(?:{GAP}(?:{LETTER}\.)+|{GAP}{LETTER}(?={GAP})|(?<=\.){LETTER}\.){{0,3}})"
    rf"(?:{GAP}(?:von|vom|van|zu|zur|de|del|de{GAP}la|de{GAP}los|du|des|della|di|da|der|den|ter|la|le|ibn|bin)){{0,3}}{GAP}(?P<last>{SURNAME})(?!\w)", re.I)
JOINT = re.compile(rf"{GAP}|-")
PART = re.compile(rf"(?:{LETTER}){{2,}}")
BARE = re.compile(rf"(?<![\w'’]){SURNAME}(?!\w)")
LONE_INITIALS = re.compile(rf"(?<!\w)(?:{LETTER}\.[^\S\r\n]*){{1,3}}$")


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


def _plain(text: str) -> str:
    return text if text.isascii() else text.translate(PLAIN)


def _digit_like(c: str, digit: str) -> str:
    """The digit in the script of another one."""
    return chr(ord(c) - unicodedata.decimal(c) + int(digit))


def _emails(text: str) -> list[tuple[int, int, str]]:
    """From each at sign to the left as far as local parts go, and to the right to the last label that begins with two letters."""
    out, upto = [], 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > upto and (text[first - 1].isalnum() or text[first - 1] in "_.%+-"):
            first -= 1
        end, label = 0, at + 1
        if first < at and text[at - 1] != ".":
            for i, part in enumerate(DOMAIN.match(text, at + 1)[0].split(".")):
                if not part:
                    break
                top = TOP_LABEL.match(part) if i else None
                end = label + top.end() if top else end
                label += len(part) + 1
        if end:
            out.append((first, end, text[first:end].lower()))
        upto = max(end, at + 1)
        at = text.find("@", upto)
    return out


def _ibans(plain: str) -> list[tuple[int, int, str]]:
    """Where the checksum holds: at the length that the country fixes, else at the longest end of a group."""
    out: list[tuple[int, int, str]] = []
    for fixed in (True, False):
        for m in IBAN.finditer(_blanked(plain, out)):
            at = [m.start() + i for i, c in enumerate(m[0]) if c != " "]
            sizes = [n for n in range(len(at), 14, -1) if not _is_sign(plain, at[n - 1] + 1)]
            for n in sizes:
                norm = "".join(plain[i] for i in at[:n])
                if (not fixed or n == IBAN_LENGTH.get(norm[:2])) and mod97(norm) == 1:
                    out.append((at[0], at[n - 1] + 1, norm))
                    break
    return out


def _is_sign(plain: str, i: int) -> bool:
    return i < len(plain) and plain[i].isascii() and plain[i].isalnum()


def _cards(plain: str) -> list[tuple[int, int, str]]:
    """Groups of digits in a row whose checksum holds: as cards are written, else the first and longest of 13 to 19 digits."""
    out = []
    for m in CARD.finditer(plain):
        groups = [(g.start(), g.end()) for g in GROUP.finditer(plain, m.start(), m.end())]
        before, after = plain[m.start() - 1 : m.start()], plain[m.end() : m.end() + 1]
        first = int(before.isalnum() or before in ("_", ".", "-"))
        last = len(groups) - int(after.isalnum() or after in ("_", "-"))
        used = [False] * len(groups)
        for usual in (True, False):
            i = first
            while i < last:
                j, ends, size = i, [], 0
                while j < last and not used[j] and size + groups[j][1] - groups[j][0] <= 19:
                    size += groups[j][1] - groups[j][0]
                    j += 1
                    if size >= 13:
                        ends.append(j)
                step = i + 1
                for j in reversed(ends) if plain[groups[i][0]] in ISSUERS else ():
                    if usual != (tuple(e - s for s, e in groups[i:j]) in CARD_GROUPS):
                        continue
                    own = _digits(plain[groups[i][0] : groups[j - 1][1]])
                    if luhn(own) == 0:
                        out.append((groups[i][0], groups[j - 1][1], own))
                        used[i:j] = [True] * (j - i)
                        step = j
                        break
                i = step
    return out


def _blanked(plain: str, spans: list) -> str:
    """The text with zeros in place of the spans: neither words nor spaces."""
    parts, upto = [], 0
    for x in sorted(spans):
        parts += [plain[upto : x[0]], "\0" * (x[1] - x[0])]
        upto = x[1]
    return "".join([*parts, plain[upto:]])


def _phones(plain: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "+" * (m[0][0] == "+") + _digits(m[0])) for m in PHONE.finditer(plain) if 7 <= len(_digits(m[0])) <= 15]


def _form(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


def _persons(text: str) -> list[tuple[int, int, str]]:
    """Given names (or a title) with a surname, then the bare surnames of these persons; the span never holds the title."""
    full: list[tuple[int, int, str, str]] = []
    low, titled = [], []
    names = [(m, f) for m in NAME_WORD.finditer(text) if (f := _form(m[0])) in STARTS]
    if not names:
        return []
    i = 0
    while i < len(names):
        first, form = names[i]
        i += 1
        if form in TITLES:
            rest = AFTER.match(text, first.end() + (text[first.end() : first.end() + 1] == "."))
            if rest and first[0][0].isupper() and rest["last"][0].isupper() and _form(rest["last"]) not in STARTS:
                titled.append((rest.end() - len(rest[0].lstrip()) if rest["initials"] else rest.start("last"), rest.start("last"), rest.end(), _form(rest["last"]), TITLES[form]))
            continue
        if form in ALSO_WORDS and not first[0][0].isupper():
            continue
        run = [(first, form)]
        while i < len(names) and names[i][1] in NAME_OF and JOINT.fullmatch(text, run[-1][0].end(), names[i][0].start()):
            run.append(names[i])
            i += 1
        # The last of several given names is the surname if none follows.
        for n in range(len(run), 0, -1):
            rest = AFTER.match(text, run[n - 1][0].end())
            last = _form(rest["last"]) if rest else ""
            initials = [c for c in rest["initials"] if c.isalpha()] if rest else []
            if not rest or any(c.islower() for c in initials) or (rest["last"].isupper() and last in NO_SURNAMES):
                continue
            norm = "-".join(f for _, f in run[:n]) + f" {last}"
            if rest["last"][0].isupper() or not rest["last"][0].islower():
                full.append((first.start(), rest.end(), norm, last))
            elif not first[0][0].isupper() or n < len(run):
                low.append((first.start(), rest.end(), norm, last))
                continue
            else:
                continue
            while i < len(names) and names[i][0].start() < rest.end():
                i += 1
            break
    known = {norm for _, _, norm, _ in full}
    out = [x for x in full] + [x for x in low if x[2] in known]
    taken = np.zeros(len(text) + 1, bool)
    for a, b, _, _ in out:
        taken[a:b] = True
    # Persons by surname, also by gender and by initial, so that a mention is a search however many there are.
    by_last: dict[tuple[str, str, str], list[tuple[int, str]]] = {}
    for a, _, norm, last in sorted(out):
        gender = NAME_OF[norm.split(" ")[0].split("-")[0]][0][1]
        for key in ((last, "", ""), (last, gender, ""), (last, "", norm[0]), (last, gender, norm[0])):
            by_last.setdefault(key, []).append((a, norm))
    title_at = {}
    for a, surname, b, last, gender in titled:
        title_at[surname] = gender
        if (last, "", "") not in by_last and not taken[a:b].any():  # nobody of that name has a given name here
            out.append((a, b, last, last))
            taken[a:b] = True
    bare = {last for *_, last in out}
    for m in BARE.finditer(text) if bare else ():
        word = _form(m[0])
        parts = [(m.start(), m.end())] if word in bare else [(m.start() + p.start(), m.start() + p.end()) for p in PART.finditer(m[0])]
        for a, b in parts:
            last = _form(text[a:b])
            if last not in bare or taken[a:b].any() or not text[a].isupper():
                continue
            norm = last
            if (last, "", "") in by_last:
                gender = title_at.get(a) or ""
                gender = gender if (last, gender, "") in by_last else ""
                same = by_last[last, gender, ""]
                norm = same[max(0, bisect_right(same, (a, "")) - 1)][1]
                initial = LONE_INITIALS.search(text, max(0, a - 24), a)
                if initial and initial[0][0].isupper() and not taken[initial.start() : a].any():
                    own = by_last.get((last, gender, initial[0][0].lower()))
                    if own:
                        a, norm = initial.start(), own[max(0, bisect_right(own, (a, "")) - 1)][1]
            out.append((a, b, norm, last))
            taken[a:b] = True
    return [x[:3] for x in out]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), none overlapping."""
    plain = _plain(text)
    found = [(a, b, "email", n) for a, b, n in _emails(text)]
    ibans = _ibans(plain)
    rest = _blanked(plain, ibans)
    ssns = [(m.start(), m.end(), _digits(m[0])) for m in SSN.finditer(rest)]
    rest = _blanked(rest, ssns)
    # A card inside a longer phone number is that phone's; one that a phone only runs into is a card.
    phones = _phones(rest)
    starts = [p[0] for p in phones]
    cards = []
    for c in _cards(rest):
        i = bisect_right(starts, c[0]) - 1
        if i < 0 or phones[i][1] < c[1] or phones[i][:2] == c[:2]:
            cards.append(c)
    rest = _blanked(rest, cards)
    found += [(a, b, "iban", n) for a, b, n in ibans] + [(a, b, "card", n) for a, b, n in cards]
    found += [(a, b, "ssn", n) for a, b, n in ssns]
    found += [(a, b, "phone", n) for a, b, n in _phones(rest)]
    found += [(m.start(), m.end(), "ip", m[0]) for m in IP.finditer(rest)]
    found += [(a, b, "person", n) for a, b, n in _persons(text)]
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class Draw:
    """Numbers from a keyed hash; the same for the same words."""

    def __init__(self, key: str, *words: str):
        self.key, self.seed, self.n = key.encode()[:64], "\0".join(words).encode(), 0

    def below(self, n: int) -> int:
        self.n += 1
        return int.from_bytes(blake2b(self.seed + b"\0%d" % self.n, key=self.key, digest_size=8).digest(), "big") % n

    def of(self, chars: Sequence[str]) -> str:
        return chars[self.below(len(chars))]


@lru_cache(64)
def _permuted(group: tuple[str, str], key: str) -> list[str]:
    names = GIVEN[group]
    draw, order = Draw(key, "given", *group), list(range(len(names)))
    for k in range(len(order) - 1, 0, -1):  # one cycle through all, so nothing stays in place
        j = draw.below(k)
        order[k], order[j] = order[j], order[k]
    return [names[k] for k in order]


def given_name(name: str, key: str = KEY) -> str:
    """The name that a keyed permutation of its own list (gender and script) puts there; never itself."""
    group, i = NAME_OF[name.lower()]
    return _permuted(group, key)[i]


@lru_cache(1 << 16)
def _alphabet(c: str) -> str:
    """The letters that may stand for a letter: those of its script, or Latin ones."""
    if c in CLASS_OF:
        return ALPHABETS[CLASS_OF[c]]
    script = unicodedata.name(c, "").split(" ")[0].lower()
    return ALPHABETS["accented" if script == "latin" else script if script in ALPHABETS else "latin"]


def _run_like(draw: Draw, own: str) -> str:
    """A run of letters or of digits that is not the same run."""
    if own[0].isdecimal():
        out = [_digit_like(c, draw.of(ALPHABETS["digit"])) for c in own]
        other = [_digit_like(own[0], c) for c in ALPHABETS["digit"]]
    else:
        out = [draw.of(_alphabet(c)) for c in own]
        other = _alphabet(own[0])
    if "".join(out) == own:
        out[0] = draw.of([c for c in other if c != own[0]])
    return "".join(out)


def _like(draw: Draw, text: str) -> str:
    """Letters for letters of the same script, digits for digits, the rest as it is; no run of letters or digits stays."""
    return RUNS.sub(lambda m: _run_like(draw, m[0]), text)


def _surname(draw: Draw, name: str, more: int = 0) -> str:
    script = "cyrillic" if CLASS_OF.get(name[0]) == "cyrillic" else "latin"
    ends = next((e for e in ("ова", "ева", "ина", "ская", "ов", "ев", "ин", "ский", "ová", "ova", "son", "ski", "ska", "ez") if name.endswith(e) and len(name) > len(e) + 1), "")
    size = max(4, min(9, len(name) - len(ends) + 1))
    stem = "".join(draw.of(CONSONANTS[script]) if i % 2 == 0 else draw.of(VOWELS[script]) for i in range(size + more))
    return stem + ends


def surrogate(kind: str, norm: str, attempt: int, key: str = KEY) -> str:
    """A normal form of the same kind and shape, never the same one; longer by one character with every attempt from ``FREE_DRAWS`` on."""
    more = max(0, attempt + 1 - FREE_DRAWS)
    for again in range(EQUAL_DRAWS):
        draw = Draw(key, kind, norm, str(attempt + (again << 20)))
        if kind == "email":
            local, _, domain = norm.partition("@")
            # The last two labels are of a domain that is reserved for examples, so no surrogate reaches anybody.
            out = f"{_like(draw, local)}{_like(draw, 'a' * more)}@" + ".".join([*(_like(draw, x) for x in domain.split(".")[:-2]), "example", ("com", "net", "org")[draw.below(3)]])
        elif kind == "ip":
            out = ".".join(str(1 + draw.below(254 * 10**more)) for _ in range(4))
        elif kind == "card":
            body = norm[0] + _like(draw, norm[1:-1] + "0" * more)
            out = body + next(c for c in "0123456789" if luhn(body + c) == 0)
        elif kind == "iban":
            body = norm[:2] + "00" + "".join(draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isalpha() else draw.of("0123456789") for c in norm[4:] + "0" * more)
            out = f"{body[:2]}{98 - mod97(body):02d}{body[4:]}"
        elif kind == "phone":
            own = norm.lstrip("+")
            code = max(0, len(own) - 10) if norm[0] == "+" else 0
            out = "+" * (norm[0] == "+") + own[:code] + _like(draw, own[code:] + "0" * more)
        elif kind == "person":
            first, _, last = norm.rpartition(" ")
            given = "-".join(given_name(x, key).lower() for x in first.split("-")) if first else ""
            out = f"{given} {_surname(draw, last, more)}".strip()
        else:
            out = _like(draw, norm + "0" * more)
        if out != norm:
            return out
    raise ValueError(f"{EQUAL_DRAWS} draws for a value of kind {kind} gave the value itself")


def _cased(own: str, new: str) -> str:
    return new.upper() if len(own) > 1 and own.isupper() else new[:1].upper() + new[1:] if own[0].isupper() or not own[0].islower() else new


def _written_person(shown: str, made: str) -> str:
    """Given names for given names, initials for initials, the surname for the surname; titles' and particles' text stays."""
    first, _, last = made.rpartition(" ")
    given = iter(first.split("-") if first else [])
    own_last = re.search(rf"{SURNAME}$", shown)
    out, spare = [], Draw(KEY, "initials", made)
    script = "cyrillic" if CLASS_OF.get(last[0]) == "cyrillic" else "latin"
    upto = 0
    for m in NAME_WORD.finditer(shown[: own_last.start()]):
        new = m[0]
        if _form(m[0]) in NAME_OF:
            new = _cased(m[0], next(given, m[0]))
        elif len(_form(m[0])) == 1:
            # An initial alone is that of the given name; one after it is drawn.
            new = (next(given, "")[:1] if not upto else "") or spare.of(ALPHABETS[script])
            new = new.upper()
        out += [shown[upto : m.start()], new]
        upto = m.end()
    return "".join([*out, shown[upto : own_last.start()], _cased(own_last[0], last)])


def written(kind: str, shown: str, made: str) -> str:
    """The surrogate in the format and case of what the text shows."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(_digits(made))
        own = next(c for c in shown if c.isdecimal())
        same = "".join(_digit_like(c, next(digits)) if c.isdecimal() else c for c in shown)
        return same + "".join(_digit_like(own, c) for c in digits)
    if kind == "iban":
        chars = iter(made)
        return "".join(next(chars) if c.isalnum() else c for c in shown) + "".join(chars)
    if kind == "ip":
        own = next(c for c in shown if c.isdecimal())
        return made if own.isascii() else "".join(_digit_like(own, c) if c.isdecimal() else c for c in made)
    if kind == "person":
        return _written_person(shown, made)
    return made.upper() if shown.isupper() else made


LOOSE = re.compile("[\u0300-\u036f]")
STARTS = frozenset(NAME_OF) | frozenset(TITLES)


def suspect(text: str) -> bool:
    """Whether an entity can be in the text: an at sign, two digits of any script, or a given name or title among its words."""
    if "@" in text or len(DIGIT.findall(text)) >= 2:
        return True
    # Letters with loose accents are put together only where names are read.
    return LOOSE.search(text) is not None or not STARTS.isdisjoint(WORD.findall(text.lower()))


def _found(raw: np.ndarray, offsets: np.ndarray) -> dict[int, tuple[str, list]]:
    data, out = raw.tobytes(), {}
    for row, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = data[start:end].decode("utf-8", "replace")
        own = entities(text) if suspect(text) else []
        if own:
            out[row] = (text, own)
    return out


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, with their distinct entities and where these stand: start, end, number of the entity, and so on."""
    for rows, raw, offsets, _ in text_slices(batches):
        found = _found(raw, offsets)
        ents, spans = [], []
        for r in range(rows.num_rows):
            own = found.get(r, ("", ()))[1]
            names = sorted({f"{k}\0{n}" for _, _, k, n in own})
            number = {e: i for i, e in enumerate(names)}
            ents.append(names)
            spans.append([x for start, end, k, n in own for x in (start, end, number[f"{k}\0{n}"])])
        cols = {f.name: rows.column(i) for i, f in enumerate(rows.schema) if f.name not in ("__ents", "__spans")}
        yield pa.RecordBatch.from_pydict(cols | {"__ents": pa.array(ents, pa.list_(pa.string())), "__spans": pa.array(spans, pa.list_(pa.int32()))})


def _drawn(key: str):
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ent, attempt = b.column("ent").to_pylist(), b.column("attempt").to_pylist()
            made = [f"{e.partition(chr(0))[0]}\0{surrogate(*e.split(chr(0), 1), a, key)}" for e, a in zip(ent, attempt, strict=True)]
            yield pa.RecordBatch.from_pydict({"ent": b.column("ent"), "attempt": b.column("attempt"), "made": pa.array(made, pa.string())})

    return drawn


def surrogates(ents: DataFrame, key: str = KEY) -> DataFrame:
    """(ent) distinct -> (ent, made): one to one, and nothing made is an entity itself."""
    real = ents.select(F.col("ent").alias("made"), F.lit("").alias("by"))  # real values: nobody may get them
    pending = ents.withColumn("attempt", F.lit(0).cast("int"))
    done = None
    for attempt in count():  # ends: the free values of every kind grow with the attempt
        tried = materialized(pending.mapInArrow(_drawn(key), "ent string, attempt int, made string"), "tried")
        taken = real if done is None else real.unionByName(done.select("made", F.lit("").alias("by")))
        claims = taken.unionByName(tried.select("made", F.col("ent").alias("by")))
        # The empty name sorts first, so values that are taken beat every claim.
        winners = claims.groupBy("made").agg(F.min("by").alias("ent"))
        good = tried.join(winners, ["made", "ent"], "left_semi").select("ent", "made")
        done = materialized(good if done is None else done.unionByName(good), "surrogates")
        bad = tried.join(done, "ent", "left_anti").select("ent", F.lit(attempt + 1).cast("int").alias("attempt"))
        pending = materialized(bad, "pending")
        if not pending.take(1):
            return done


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("text", "__ents", "__spans", "__map")}
        texts, counts = [], {f"n_{k}": [] for k in KINDS}
        for text, ents, spans, pairs in zip(*own.values(), strict=True):
            made = {p["ent"]: p["made"].split("\0", 1)[1] for p in pairs}
            out, upto, seen = [], 0, dict.fromkeys(KINDS, 0)
            for start, end, i in zip(spans[::3], spans[1::3], spans[2::3], strict=True):
                kind = ents[i].partition("\0")[0]
                out += [text[upto:start], written(kind, text[start:end], made[ents[i]])]
                upto = end
                seen[kind] += 1
            texts.append("".join([*out, text[upto:]]))
            for k in KINDS:
                counts[f"n_{k}"].append(seen[k])
        cols = {f.name: b.column(i) for i, f in enumerate(b.schema) if f.name not in ("text", "__ents", "__spans", "__map", *counts)}
        yield pa.RecordBatch.from_pydict(cols | {"text": pa.array(texts, pa.string())} | {k: pa.array(v, pa.int64()) for k, v in counts.items()})


def pseudonymized(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with surrogates in their texts, and the number of entities of each kind.

    Entities are looked for once; the marked documents are a table, and both those with and those without entities are read from it.
    """
    prepare(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*[c for c in docs.columns if c in counts])
    bare = docs.withColumns({"__ents": F.array().cast("array<string>"), "__spans": F.array().cast("array<int>")})
    marked = materialized(bare.mapInArrow(_marked, bare.schema).withColumn("__rid", F.monotonically_increasing_id()), "marked")
    named = marked.filter(F.size("__ents") > 0)
    each = named.select("__rid", F.explode("__ents").alias("ent"))
    made = surrogates(materialized(each.select("ent").distinct(), "distinct-entities"), key)
    maps = each.join(made, "ent").groupBy("__rid").agg(F.collect_list(F.struct("ent", "made")).alias("__map"))
    plain = marked.filter(F.size("__ents") == 0).select(*docs.columns).withColumns({c: F.lit(0).cast("long") for c in counts})
    names = [c for c in docs.columns if c != "text"] + ["text", *counts]
    whole = named.join(maps, "__rid").select(*[c for c in docs.columns if c != "text"], "text", "__ents", "__spans", "__map")
    return plain.unionByName(whole.mapInArrow(_replace, plain.select(*names).schema))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"))
