"""Personal data in free text: found through a normalised view that keeps the way back to the source."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person")

# Letters that look like Latin ones, and words for digits.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXaeopcyxijsdhABEZHIKMNOPTYXo", strict=True))
DASHES = "‐‑‒–—―−－"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
PARTICLES = frozenset("van der den von zu de la los del della di da dos le al bin ibn".split())
#: Beginnings of family names that are written together with the rest.
PREFIXES = ("o'", "d'", "mc", "mac")
# Legal forms and common words for organisations, which make what stands before them no person.
ORGANISATIONS = frozenset(
    (
        "ag kg ug ohg gbr gmbh ev eg ltd limited llc llp lp plc inc incorporated corp corporation co company sarl sas sasu eurl snc sa sl slu srl spa bv nv oy ab as aps "
        "group holding team studio studios agency bureau office services service solutions consulting consultants partners associates labs lab media marketing design digital software systems technologies "
        "bakery catering cafe coffee restaurant bar hotel shop store market supermarket pharmacy clinic hospital school college university academy institute foundation association club church museum gallery theatre "
        "street road avenue lane drive court square place park station bridge hall centre center tower airport"
    ).split()
)
# Street words.
STREET_AFTER = "Street|St\\.?|Avenue|Ave\\.?|Road|Rd\\.?|Lane|Ln\\.?|Drive|Dr\\.?|Court|Ct\\.?|Boulevard|Blvd\\.?|Close|Mews|Terrace|Way|Crescent|Square|Place|Gardens|Row|Walk|Parkway|Highway"
STREET_END = "straße|strasse|str\\.?|gasse|platz|weg|allee|ring|damm|ufer|steig"
STREET_BEFORE_FR = "rue|avenue|av\\.|boulevard|bd|chemin|impasse|allée|quai|cours|route|square|place|passage"
STREET_BEFORE_ES = "Calle|C/|Avenida|Avda\\.?|Paseo|Plaza|Camino|Ronda|Carrer|Travesía|Vía"

UP, LOW = "A-ZÀ-ÖØ-ÞŁŚŻŽŠČ", "a-zß-öø-ÿłśżźćńąęžšč"
LETTER = UP + LOW

_AT_WORD = re.compile(r"(?<=\w) (?:AT|\(AT\)|@|\[at\]|\(at\)|\{at\}|\[ at \]|\( at \)) (?=\w)|(?<=[\w+-])(?:\(at\)|\[at\]|\{at\}|\(AT\)|\[AT\])(?=\w)")
_DOT = re.compile(r"(?<=\w) (?:DOT|\[dot\]|\(dot\)|\{dot\}|\[ dot \]|\(DOT\)|\[DOT\]|\.) (?=\w)|(?<=\w)(?:\[dot\]|\(dot\)|\{dot\}|\(DOT\)|\[DOT\])(?=\w)")
# Words before "at" that are no mailbox.
NO_MAILBOX = "look|looking|find|found|us|me|it|see|sold|buy|shop|store|available|live|online|site|website|page|are|is|was|work|working|works|here|there|back|order|ordered|visit|read|more"
_LOWER = re.compile(rf"(?<![\w.+%@-])(?!(?:{NO_MAILBOX}) at )[\w+%'-]+(?:(?: dot |\.)[\w+%'-]+)* at [\w-]+(?:(?: dot |\.)[\w-]+)* dot [a-z]{{2,24}}(?![\w-])", re.I)
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?:double |triple )?(?:{_WORDS})(?:[ ,-]+|(?!\w))){{6,}}", re.I)
_STRANGE = re.compile(f"[{''.join(LOOKALIKES)}{DASHES}{INVISIBLE}\u00a0\u2000-\u200a\u202f\u205f\u3000\uff01-\uff5e\u2460-\u24ff’ʼ]|[\U0001d400-\U0001d7ff]")


class View:
    """A text as rewritten by transducers; every character knows the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.words: set[str] = set()
        self.start: list[int] | None = None
        self.end: list[int] | None = None

    def rewrite(self, pattern: re.Pattern, put) -> None:
        """Replace each match by put(match); a replacement's characters all stand for the whole match."""
        found = list(pattern.finditer(self.text))
        if not found:
            return
        start = self.start or list(range(len(self.text)))
        end = self.end or list(range(1, len(self.text) + 1))
        text, s, e, at = [], [], [], 0
        for m in found:
            a, b = m.span()
            new = put(m)
            text += [self.text[at:a], new]
            s += start[at:a] + [start[a]] * len(new)
            e += end[at:a] + [end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.start, self.end = "".join(text), s + start[at:], e + end[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c in "’ʼ":
        return "'"
    return LOOKALIKES.get(c) or ("".join(unicodedata.normalize("NFKC", c)) if not c.isspace() else " ")


def _digits(m: re.Match) -> str:
    out, times = "", 1
    for w in re.findall(r"\w+", m[0].lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out, times = out + DIGIT_WORDS[w] * times, 1
    return out + " " * (len(m[0]) - len(m[0].rstrip(" ,-")) > 0)


WORD = re.compile(r"[^\W\d_]+")
_DIGIT_WORDS = frozenset(DIGIT_WORDS)
_HIDDEN_AT = re.compile(r" AT |[@＠] | [@＠]|[([{] ?(?i:at) ?[)\]}]")


def normalised(text: str) -> View:
    """The view in which disguises are undone: look-alikes and odd dashes, spelled digits, at and dot in words or brackets.

    A rewriting is tried where a word or sign is there that each of its matches has.
    """
    v = View(text)
    if not text.isascii():
        v.rewrite(_STRANGE, _plain)
    seen = v.text
    low = seen.lower()
    v.words = set(WORD.findall(low))
    if len(_DIGIT_WORDS.intersection(v.words)) > 1:
        v.rewrite(_SPELLED, _digits)
    if " dot " in low and " at " in low:
        v.rewrite(_LOWER, lambda m: re.sub(" dot ", ".", re.sub(" at ", "@", m[0], flags=re.I), flags=re.I))
    if _HIDDEN_AT.search(v.text):
        v.rewrite(_AT_WORD, lambda m: "@")
    if "@" in v.text and (" . " in v.text or "dot" in low):
        v.rewrite(_DOT, lambda m: ".")
    if v.text is not seen:
        v.words = set(WORD.findall(v.text.lower()))
    return v


EMAIL = re.compile(rf"(?<![\w.+%-])[\w][\w.+%'-]*@(?:[\w](?:[\w-]*[\w])?\.)+[{LETTER}]{{2,}}(?![\w-])")

_NO = r"(?:\s*(?:[:#=]|n[°º]|\bnumbers?\b|\bno\b\.?|\bnr\b\.?|\bnum\b\.?|\bnumber\b|\bnuméro\b|\bnúmero\b|\bis\b|\bes\b|\bist\b|\best\b|\blautet\b|\bID\b))*\s*"
_LABELS = {
    r"SSN|social security|my social|social insurance|SIN": r"\d{3}[- .]?\d{2,3}[- .]?\d{3,4}",
    r"NINO|NI|National Insurance": r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    r"Steuer-?ID|Steuer-?IdNr\.?|Steuer-?Identifikationsnummer|Steueridentifikationsnummer|IdNr\.?": r"\d{2} ?\d{3} ?\d{3} ?\d{3}",
    r"NIR|numéro de sécurité sociale|numéro de sécu|sécurité sociale|INSEE": r"[1-478] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?",
    r"DNI|NIF|NIE": r"(?:[XYZ]-?)?\d{1,2}\.?\d{3}\.?\d{2,3}[- ]?[A-Z]",
    r"passport|Reisepass|passeport|pasaporte|ID card|identity card|Personalausweis|Ausweis|carte d'identité|carte nationale d'identité|driving licen[cs]e|driver'?s licen[cs]e|licen[cs]e|Führerschein|permis de conduire|permiso de conducir|tax ID|CURP|RFC": r"(?=[A-Z-]*\d)[A-Z0-9]{1,6}(?:-[A-Z0-9]{3,6}){1,3}|(?=[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{6,18}",
}
IDS = [re.compile(rf"(?<![\w-])(?i:{label}){_NO}((?-i:{value}))(?![\w])") for label, value in _LABELS.items()]
#: By pattern of IDS: beginnings of words of which a text needs one to match.
ID_WORDS = [
    ("ssn", "social", "sin"), ("nino", "ni", "national"), ("steuer", "idnr"), ("nir", "numéro", "sécurité", "insee"), ("dni", "nif", "nie"),
    ("passport", "reisepass", "passeport", "pasaporte", "id", "identity", "personalausweis", "ausweis", "carte", "driving", "driver", "licen", "führerschein", "permis", "tax", "curp", "rfc"),
]
_ID_WORD = re.compile(rf"(?<![^\W\d_])({'|'.join(sorted((w for own in ID_WORDS for w in own), reverse=True))})")


_SEP = r"(?: ?/ ?|[.-]| )"
_EXT = r"(?:,? ?(?:ext\.?|x|extension|poste|Durchwahl|DW) ?\d{1,5})?"
PHONES = [
    re.compile(rf"(?<![\w+.-])\+\d{{1,3}}(?:{_SEP}?\(\d{{1,4}}\))?(?:{_SEP}?\d{{1,12}}){{1,7}}{_EXT}(?![\w])"),
    re.compile(rf"(?<![\w+.#/-])(?:1{_SEP})?(?:\(\d{{3}}\) ?|\d{{3}}[-. ])\d{{3}}[-. ]\d{{4}}{_EXT}(?![\w-])"),
    re.compile(rf"(?<![\w+.#/-])00[1-9]\d{{0,2}}(?:{_SEP}?\(\d{{1,4}}\))?(?:{_SEP}\d{{1,8}}){{2,6}}{_EXT}(?![\w])"),
    re.compile(rf"(?<![\w+.#/-])(?:\(0\d{{1,4}}\)|0\d{{1,4}})(?:{_SEP}\d{{2,8}}){{1,5}}{_EXT}(?![\w])"),
    re.compile(rf"(?<![\w+.#/-])0\d{{9,10}}{_EXT}(?![\w])"),
]
CALL = re.compile(rf"(?i:\b(?:tel|tél|telefon|telephone|phone|mobile|cell|whatsapp|call me on|call|text me|handy|fax|appeler le|contacto|ruf)\b[ .:=]{{1,3}})(\+?\(?\d[\d ()./-]{{6,18}}\d){_EXT}(?![\w])")

#: Nine digits with nothing but separators between them, which each phone number has.
_PHONE_LIKE = re.compile(r"(?:\d[ ()./-]{0,18}){8}\d")

_NAMES = rf"(?:[{UP}][\w'-]*\.?)(?: [{UP}][\w'-]*){{0,2}}"
ADDRESSES = [
    re.compile(rf"(?<![\w.:/#-])\d{{1,5}}[a-zA-Z]?,? {_NAMES} (?:(?i:{STREET_AFTER}))(?![\w'])"),
    re.compile(rf"(?<![\w.:/#-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-d]))?,? (?i:{STREET_BEFORE_FR}) (?:(?i:de la|de l'|des|du|de|d') ?)?[{UP}][\w'-]+"),
    re.compile(rf"(?<![\w-])[{UP}][\w-]*(?i:{STREET_END}) \d{{1,4}}(?: ?[a-hA-H](?![\w]))?(?![\w])"),
    re.compile(rf"(?<![\w-])[{UP}][\w-]+(?: [{UP}][\w-]+)? (?:Straße|Strasse|Str\.|Gasse|Platz|Weg|Allee|STRASSE|ALLEE|PLATZ|WEG) \d{{1,4}}(?: ?[a-h](?!\w))?(?!\w)"),
    re.compile(rf"(?<![\w-])(?i:{STREET_BEFORE_ES}) ?(?:(?i:de la|de los|de las|del|de) )?[{UP}][\w'-]+(?: [{UP}][\w'-]+)?,? (?:n?[º°.]? ?)?\d{{1,4}}(?![\w])"),
]
#: By pattern of ADDRESSES: words in lower case one of which a text needs; the two of streets' ends need a text with _STREET_END.
_lower_words = lambda t: frozenset(re.findall(r"[^\W\d_]+", t.replace("\\.?", "").lower()))
_AFTER, _FRENCH, _SPANISH = _lower_words(STREET_AFTER), _lower_words(STREET_BEFORE_FR.replace("\\.", "")), _lower_words(STREET_BEFORE_ES)
_STREET_END = re.compile(rf"(?:{STREET_END})\b\.? \d".replace("\\.?|", "|").replace("\\.?)", ")"))
_NUMBERED = re.compile(r"[erzgm]\.? \d")
_EXTENSION = re.compile(r"(?i)(?:e?xt?\.?|poste|Durchwahl|DW) ?\d+$")

# What stands before a name that need not be known.
SELF = "my name is|my name's|ich heiße|mein Name ist|je m'appelle|mon nom est|me llamo|mi nombre es"
SIGNED = "kind regards|best regards|warm regards|regards|sincerely|yours|cheers|many thanks|mit freundlichen Grüßen|viele Grüße|cordialement|saludos"
GREETING = "dear|hello|hi|hallo|bonjour|hola|liebe|lieber|estimado|estimada"
TITLE = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sra|Don|Doña"
ASKED = "ask for|asked for|spoke to|spoke with|talked to|talked with|attn|attention of|zu Händen|à l'attention de|a la atención de|preguntar por"
_PARTICLES = "van der|van den|van|von der|von|zu|de la|de los|de|del|della|di|da|dos|la|le|al|bin|ibn"
_PART = rf"(?!(?:The|And|Our|We|I|It|Please|You|This|That)\b)(?:O'|Mc|Mac|D')?[{UP}][{LOW}]+(?:[-'][{UP}][{LOW}]+)*"
_SHAPE = rf"(?:{_PART}|[{UP}]\.)(?: [{UP}]\.)*(?: (?:{_PARTICLES}))?(?: {_PART}){{1,2}}"
_words = lambda *texts: frozenset(w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()))
#: A pattern whose first group is a name, and words one of which it needs.
IN_CONTEXT = [
    (re.compile(rf"(?<![\w])(?i:{SELF}) ({_SHAPE}|{_PART})(?![\w@&-]|\.\w)"), _words("name heiße appelle nom llamo nombre")),
    (re.compile(rf"(?<![\w])(?i:{SIGNED})(?:, ?|,?\s*\n\s*)({_SHAPE})(?=\s*(?:\Z|\n))"), _words("regards sincerely yours cheers thanks grüßen grüße cordialement saludos")),
    (re.compile(rf"(?:(?<=\n)|\A)(?i:{GREETING}) (?:(?:{TITLE})\b\.? )?({_SHAPE})(?=[,!]?\s*\n|,)"), _words(GREETING)),
    (re.compile(rf"(?<![\w])(?:{TITLE})\b\.? ({_SHAPE}|{_PART})(?![\w@&-]|\.\w)"), _words(TITLE)),
    (re.compile(rf"(?<![\w])(?i:{ASKED}):? (?:(?:{TITLE})\b\.? )?({_SHAPE})(?![\w@&-]|\.\w)"), _words("ask asked spoke talked attn attention händen atención preguntar")),
]
_THING = rf"[{UP}][\w'-]+(?: [{UP}][\w'-]+){{0,2}}"
_IS = "are|is|sont|est|sind|ist|son|es"
_OF = "our|a|an|the|unsere|ein|eine|nos|un|une|nuestros|una"
_KIND = "products?|brands?|shops?|playlists?|songs?|places?|Produkte?|Marken?|produits?|marques?|productos?|marcas?"
#: What a text itself says is a thing.
THINGS = re.compile(rf"{_THING}(?:(?:,| and| und| et| y| &) {_THING})* (?:{_IS}) (?:{_OF}) (?:{_KIND})\b")
URL = re.compile(r"(?:https?://|www\.)[^\s<>\"]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_PREFIXED = re.compile(rf"(?i)(?<![^\W\d_])(?:{'|'.join(PREFIXES)})")
#: Words one of which THINGS needs.
_THING_WORDS = frozenset(w for k in _KIND.lower().split("|") for w in (k.replace("?", ""), k.replace("s?", "").replace("n?", "").replace("e?", "")))


class Names:
    """Given and family names in lower case, learned from a column of names, and fixed phrases that only look like a name.

    A name of two parts joined by a hyphen is known if both parts are.
    """

    def __init__(self, given: Iterable[str] = (), family: Iterable[str] = (), phrases: Iterable[tuple[str, str]] = ()):
        self.given, self.family, self.phrases = frozenset(given), frozenset(family), frozenset(phrases)
        self.any = self.given | self.family

    def persons(self, text: str, words: set[str]) -> list[tuple[int, int]]:
        """Spans of names in text: full names, in either order, names with initials, and parts of names that stand alone.

        A full name of two known parts counts in any case; all else must begin with a capital. A given name before an
        unknown capitalised word is a full name, unless the two are a fixed phrase or an organisation's word follows.
        """
        if self.any.isdisjoint(words) and not _PREFIXED.search(text):
            return []
        found = [m.span() for m in TOKEN.finditer(text)]
        tokens = []
        for a, b in found:
            t = text[a:b]
            if t[-2:] in ("'s", "'S"):
                t, b = t[:-2], b - 2
            tokens.append((a, b, t, t.lower()))
        n = len(tokens)

        def known(word: str, names: frozenset) -> bool:
            if word in names:
                return True
            if "-" in word:
                return all(p and known(p, names) for p in word.split("-"))
            return names is self.family and word.startswith(PREFIXES) and any(word.startswith(p) and word[len(p) :] in names for p in PREFIXES)

        gap = lambda i: text[tokens[i][1] : tokens[i + 1][0]] if i + 1 < n else ""

        def initials(i: int, any_case: bool = False) -> int:
            """The last of up to two initials after token i, else i."""
            for _ in range(2):
                if i + 1 < n and (gap(i) == " " or (gap(i) == ". " and len(tokens[i][2]) == 1)) and len(tokens[i + 1][2]) == 1 and (any_case or tokens[i + 1][2].isupper()) and (text[tokens[i + 1][1] : tokens[i + 1][1] + 1] == "." or (gap(i + 1) == " " and tokens[i + 2][2][0].isupper())):
                    i += 1
                else:
                    break
            return i

        def end_of(i: int) -> int:
            """The end of token i, with the dot of an initial."""
            a, b, t, _ = tokens[i]
            return b + 1 if len(t) == 1 and text[b : b + 1] == "." and not text[b + 1 : b + 2].isalnum() else b

        def family_at(i: int, after: str | None = None) -> tuple[int, bool] | None:
            """The token of a family name that follows token i, particles passed, and whether it is known."""
            j = i + 1
            if j >= n or gap(i) not in (" ", after or (". " if len(tokens[i][2]) == 1 else " ")):
                return None
            for _ in range(2):
                if j + 1 < n and tokens[j][3] in PARTICLES and gap(j) == " ":
                    j += 1
            t = tokens[j]
            if known(t[3], self.family):
                return j, True
            return (j, False) if len(t[2]) > 1 and t[2][0].isupper() and (t[2][1:].islower() or t[2].isupper() or "-" in t[2] or "'" in t[2]) else None

        def before(i: int) -> int:
            """The start of the particles before token i, else its own."""
            for _ in range(2):
                if i and tokens[i - 1][3] in PARTICLES and gap(i - 1) == " ":
                    i -= 1
            return tokens[i][0]

        def organisation(i: int) -> bool:
            """Whether what follows token i makes it the name of a firm or a place."""
            return (i + 1 < n and gap(i) in (" ", "-") and tokens[i + 1][3] in ORGANISATIONS) or text[tokens[i][1] : tokens[i][1] + 3] == " & "

        spans: list[tuple[int, int]] = []
        i = 0
        while i < n:
            a, b, t, low = tokens[i]
            here, i = i, i + 1
            if low not in self.any and len(t) > 1 and "-" not in low and not low.startswith(PREFIXES):
                continue
            if (a and text[a - 1] in "@._-" ) or text[b : b + 1] == "@" or (a and text[a - 1].isalnum()) or text[b : b + 1].isalnum():
                continue
            cap = t[0].isupper()
            if len(t) == 1:
                last = here
                if cap and text[b : b + 1] == ".":
                    if here + 1 < n and gap(here) in (". ", ".") and len(tokens[here + 1][2]) == 1 and tokens[here + 1][2].isupper():
                        last = here + 1
                    got = family_at(last) or (family_at(last, ".") if text[tokens[last][1] : tokens[last][1] + 1] == "." else None)
                    if got and got[1] and tokens[got[0]][2][0].isupper() and text[tokens[last][1]] == "." and not organisation(got[0]):
                        spans.append((a, tokens[got[0]][1]))
                        i = got[0] + 1
                continue
            is_family = known(low, self.family)
            if is_family and here + 1 < n and gap(here) == ", ":
                nxt = tokens[here + 1]
                if known(nxt[3], self.given) and (nxt[2][0].isupper() or not cap):
                    last = initials(here + 1)
                    spans.append((before(here), end_of(last)))
                    i = last + 1
                    continue
                if cap and len(nxt[2]) == 1 and nxt[2].isupper() and text[nxt[1] : nxt[1] + 1] == ".":
                    last = initials(here + 1)
                    spans.append((before(here), end_of(last)))
                    i = last + 1
                    continue
            if known(low, self.given):
                last = here
                if here + 1 < n and gap(here) == " " and known(tokens[here + 1][3], self.given) and (tokens[here + 1][2][0].isupper() or not cap):
                    beyond = family_at(initials(here + 1))
                    if beyond or not known(tokens[here + 1][3], self.family):
                        last = here + 1
                last = initials(last)
                if not cap and last == here:
                    last = initials(here, any_case=True)
                got = family_at(last)
                if got and (got[1] or cap):
                    j, sure = got
                    pair = (low, tokens[j][3])
                    if sure:
                        spans.append((a, tokens[j][1]))
                        i = j + 1
                        continue
                    more = j + 1 < n and gap(j) == " " and tokens[j + 1][2][0].isupper() and tokens[j + 1][3] not in self.any
                    if pair in self.phrases or tokens[j][3] in ORGANISATIONS or organisation(j) or more:
                        i = j + 1
                        continue
                    spans.append((a, tokens[j][1]))
                    i = j + 1
                    continue
                if cap and not organisation(last):
                    nxt = tokens[last + 1][3] if gap(last) == " " else ""
                    if (low, nxt) not in self.phrases:
                        spans.append((a, end_of(last)))
                        i = last + 1
                continue
            if is_family and cap and not organisation(here):
                spans.append((a, b))
        return spans


def learn_names(df: DataFrame, names: tuple[str, ...] = ("name",), texts: tuple[str, ...] = (), least: float = 1 / 50_000, phrase: float = 1 / 1000) -> Names:
    """Names, learned from all rows of columns that mostly hold names of persons.

    What a value holds beside the name (addresses in brackets, numbers, remarks in parentheses) is left out, and values
    with a word of ORGANISATIONS. Of 'A B' and 'B, A', A is a given name if it has three different B, and B a family
    name if it has two different such A. Both must be in at least least of all names (and in two), so there are at most
    1/least of each, which bounds what is collected and sent to the workers. A phrase is a given name in texts with a
    following word that is no family name and follows no other given name, in phrase of all rows and five at least; there
    are at most 1/phrase for each of a text's words. An empty or null column teaches nothing.
    """
    clean = None
    for c in names:
        v = F.regexp_replace(F.col(c), r"<[^>]*>|\([^)]*\)|\S*@\S*|[+(]?\d[\d ()./-]*", " ")
        v = F.lower(F.trim(F.regexp_replace(v, r"\s+", " ")))
        one = df.select(v.alias("v")).where(F.length("v") > 2)
        clean = one if clean is None else clean.unionByName(one)
    word = r"\p{L}[\p{L}'’-]+"
    between = rf"(?: \p{{L}}\.?)*(?: (?:{_PARTICLES}))?"
    straight, turned = rf"^({word}){between} ({word})$", rf"^(?:(?:{_PARTICLES}) )?({word}), ({word})(?: \p{{L}}\.?)*$"
    first = F.coalesce(F.nullif(F.regexp_extract("v", straight, 1), F.lit("")), F.regexp_extract("v", turned, 2))
    last = F.coalesce(F.nullif(F.regexp_extract("v", straight, 2), F.lit("")), F.regexp_extract("v", turned, 1))
    pairs = clean.select(first.alias("a"), last.alias("b")).where("a <> '' and b <> ''").where(~F.col("a").isin(*ORGANISATIONS) & ~F.col("b").isin(*ORGANISATIONS)).groupBy("a", "b").agg(F.count("*").alias("n")).persist()
    total = pairs.agg(F.sum("n")).first()[0] or 0
    enough = max(2.0, total * least)
    given = pairs.groupBy("a").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") >= 3) & (F.col("n") >= enough)).select("a")
    family = pairs.join(F.broadcast(given), "a").select("a", F.explode(F.split("b", "-")).alias("b"), "n").groupBy("b").agg(F.count_distinct("a").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") >= 2) & (F.col("n") >= enough)).select("b")
    g, f = [r[0] for r in given.collect()], [r[0] for r in family.collect()]
    pairs.unpersist()
    phrases: list[tuple[str, str]] = []
    if g and texts:
        rows = None
        for c in texts:
            found = F.regexp_extract_all(F.col(c), F.lit(rf"\p{{Lu}}[\p{{L}}]+(?= {word})"), F.lit(0))
            next_ = F.regexp_extract_all(F.col(c), F.lit(rf"\p{{Lu}}[\p{{L}}]+(?= ({word}))"), F.lit(1))
            one = df.select(F.explode(F.array_distinct(F.arrays_zip(found.alias("a"), next_.alias("b")))).alias("x")).select(F.lower("x.a").alias("a"), F.lower("x.b").alias("b"))
            rows = one if rows is None else rows.unionByName(one)
        known = df.sparkSession.createDataFrame([(x,) for x in g], "a string")
        met = rows.join(F.broadcast(known), "a").where(~F.col("b").isin(*PARTICLES)).groupBy("a", "b").agg(F.count("*").alias("n"))
        alone = met.groupBy("b").agg(F.count("*").alias("kinds"), F.max_by("a", "n").alias("a"), F.max("n").alias("n")).where((F.col("kinds") == 1) & (F.col("n") >= max(5.0, phrase * df.count())))
        own = frozenset(f)
        phrases = [(r["a"], r["b"]) for r in alone.collect() if not all(p in own for p in r["b"].split("-"))]
    return Names(g, f, phrases)


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        out += [text[at:a], "\x00" * (b - a)]
        at = b
    return "".join([*out, text[at:]])


_DIGIT = re.compile(r"\d")


def _n_digits(text: str) -> int:
    return len(_DIGIT.findall(text))


UNKNOWN = Names()


def find(text: str, name: bool = False, names: Names = UNKNOWN) -> list[tuple[str, int, int]]:
    """(kind, first, end) of personal data in text, in order, without overlap; positions count code points of text.

    Kinds are sought in the order e-mail, identity number (after its label), phone, address, person; what one has taken
    the next don't see, nor what stands in a URL. Persons are names that names knows, and those that context gives away.
    name: the text is the field for a name, in which a lone given name counts in any case. A pattern is tried where the
    text has a sign or word without which it can't match.
    """
    v = normalised(text)
    body = v.text
    low = body.lower()
    words = v.words
    if "://" in body or "www." in body:
        body = _mask(body, [m.span() for m in URL.finditer(body) if "@" not in m[0]])
    out: list[tuple[str, int, int]] = []

    def take(kind: str, spans: list[tuple[int, int]]) -> None:
        nonlocal body
        if spans:
            out.extend((kind, a, b) for a, b in spans)
            body = _mask(body, spans)

    if "@" in body:
        take("email", [m.span() for m in EMAIL.finditer(body)])
    if _DIGIT.search(body):
        if met := {m[1] for m in _ID_WORD.finditer(low)}:
            for p, own in zip(IDS, ID_WORDS, strict=True):
                if any(w.startswith(own) for w in met):
                    take("id_number", [m.span(1) for m in p.finditer(body)])
        german = _NUMBERED.search(low) is not None and _STREET_END.search(low) is not None
        for i, near in ((1, not _FRENCH.isdisjoint(words)), (0, not _AFTER.isdisjoint(words)), (2, german), (3, german), (4, not _SPANISH.isdisjoint(words))):
            if near:
                take("address", [m.span() for m in ADDRESSES[i].finditer(body)])
        if _PHONE_LIKE.search(body):
            for p in PHONES:
                take("phone", [m.span() for m in p.finditer(body) if 9 <= _n_digits(_EXTENSION.sub("", m[0])) <= 15])
            take("phone", [m.span(1) for m in CALL.finditer(body) if 9 <= _n_digits(m[1]) <= 15])
    things = [m.span() for m in THINGS.finditer(body)] if not names.any.isdisjoint(words) and not _THING_WORDS.isdisjoint(words) else []
    body = _mask(body, things)
    take("person", names.persons(body, words))
    for p, own in IN_CONTEXT:
        if not own.isdisjoint(words):
            take("person", [m.span(1) for m in p.finditer(body) if not ORGANISATIONS.intersection(WORD.findall(f"{m[1]} {body[m.end() : m.end() + 24].partition('.')[0].partition(',')[0]}".lower()))])
    if name and words and " " not in body.strip() and (m := TOKEN.fullmatch(body.strip())) and m[0].lower() in names.given:
        at = body.index(m[0])
        take("person", [(at, at + len(m[0]))])
    return sorted(((k, *v.source(a, b)) for k, a, b in out), key=lambda x: x[1:])


def redact(text: str, found: list[tuple[str, int, int]] | None = None, name: bool = False, names: Names = UNKNOWN) -> str:
    """text with a typed placeholder, as [EMAIL], in the place of each item, otherwise unchanged."""
    out, at = [], 0
    for kind, a, b in find(text, name, names) if found is None else found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_data(df: DataFrame, key: str, fields: tuple[str, ...], name_fields: tuple[str, ...] = ("name",), names: Names = UNKNOWN) -> DataFrame:
    """key (string), field, kind, start_pos, end_pos of every item in fields, once per key whatever its copies.

    Null and empty texts have no items; texts of any length are searched whole. Differing texts under one key give
    the items of each. names: what learn_names returns, sent to the workers; without it persons are found by context
    alone. One narrow pass; only the found positions are shuffled, to count copies once.
    """

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [(k, f, kind, a, b) for i, f in enumerate(fields, 1) for k, t in zip(keys, batch.column(i).to_pylist(), strict=True) if t for kind, a, b in find(t, f in name_fields, names)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["key", "field", "kind", "start_pos", "end_pos"])

    src = df.select(F.col(key).cast("string").alias("key"), *fields)
    return src.mapInArrow(run, "key string, field string, kind string, start_pos int, end_pos int").distinct().withColumnRenamed("key", key)


def redacted(df: DataFrame, key: str, fields: tuple[str, ...], name_fields: tuple[str, ...] = ("name",), names: Names = UNKNOWN) -> DataFrame:
    """key and fields, each item of personal data replaced by its placeholder; nulls stay null; rows stay as they come."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(0)]
            for i, f in enumerate(fields, 1):
                cols.append(pa.array([t if not t else redact(t, name=f in name_fields, names=names) for t in batch.column(i).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[key, *fields])

    return df.select(F.col(key).cast("string").alias(key), *fields).mapInArrow(run, f"`{key}` string, " + ", ".join(f"`{f}` string" for f in fields))
