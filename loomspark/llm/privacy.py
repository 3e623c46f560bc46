"""Personal information in free text: anchors by Aho-Corasick, local parsers that expand and validate."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "national_id", "address", "person")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# The commonest given names of several countries; one sign of a person among others.
GIVEN_NAMES = """
    james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua
    kenneth kevin brian george edward mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra
    ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura helen sharon cynthia kathleen amy angela emma olivia
    hans peter wolfgang klaus jürgen michael stefan andreas uwe werner günter dieter horst heinz ursula monika petra sabine renate karin brigitte
    ingrid andrea julia katharina jean pierre michel andré philippe alain bernard jacques daniel nicolas marie nathalie isabelle sylvie catherine
    françoise martine christine monique valérie camille léa antonio josé manuel francisco juan javier carlos jesús alejandro miguel rafael pedro
    maría carmen ana isabel dolores pilar teresa rosa cristina lucía giovanni giuseppe marco francesca paolo luca olga ivan natalia sergei anna
    dmitri wei li ming mei hiroshi yuki kenji mohammed ahmed ali fatima aisha omar priya rahul amit sunita sven björn lars ingvar astrid piotr
    """.split()
# Titles that stand before a name.
TITLES = "dr. prof. m. mr. mrs. ms. frau herr mme. mme mlle monsieur madame sr. sra. señor señora don doña".split()
# Words after which a person is named, in any style of letters.
ADDRESSED = """
    attention|attn|attn.|attn:|c/o|ask for|speak to|speak with|contact|contacter|contactez|contactar a|contactar con|kontakt|ansprechpartner
    |ansprechpartnerin|zu händen|z. hd.|z.hd.|rückfragen an|fragen an|wenden sie sich an|avisar a|avise a|preguntar por|preguntar a|a nombre de
    |à l'attention de|a la atención de|atención|au nom de|de la part de|de parte de|on behalf of|in the name of|im auftrag von|im namen von
    |pass for|ausweis für|spoke with|spoke to|met with|talked to|talked with|holder|accused,|defendant|plaintiff|witness|signed,|minutes by|present:|participants:
    |attendees:|teilnehmer:|présents :|asistentes:|dear|estimado|estimada|chère|liebe|lieber|sincerely,|regards,|grüße,|cordialement,|saludos,
    """.replace("\n", "").split("|")
# Names of fields that hold a person.
FIELDS = """
    author|owner|actor|name|full name|fullname|user|username|user name|contact|reviewer|assignee|maintainer|reporter|sender|recipient|customer
    |client|patient|employee|manager|signed-off-by|reviewed-by|co-authored-by|reported-by|todo|fixme|autor|autorin|verfasser|bearbeiter|auteur|nom
    |nombre|nombre completo|responsable|ping|cc|from|attendees|participants|interviewer|teilnehmer
    """.replace("\n", "").split("|")
# Those of them that hold nothing else.
WRITERS = frozenset("author owner actor reviewer assignee maintainer reporter autor autorin verfasser bearbeiter auteur signed-off-by reviewed-by co-authored-by reported-by".split())
# Prepositions of an agent, and the participles before them (or their beginnings) that only persons cause.
AGENTS = {"by": "en", "par": "fr", "por": "es", "von": "de"}
DEEDS = {
    "en": "requested forwarded opened reviewed taken written given made signed approved reported submitted authored edited prepared assigned posted sent filed raised closed checked merged committed confirmed translated drafted told noted led taught asked answered handled".split(),
    "fr": "relu vérifié rédigé écrit signé validé approuvé envoyé transmis demandé ouvert traduit préparé noté posé relue vérifiée rédigée écrite signée validée approuvée envoyée transmise demandée ouverte traduite préparée".split(),
    "es": "revisado escrito firmado aprobado enviado solicitado abierto redactado preparado traducido comprobado reenviado revisada escrita firmada aprobada enviada solicitada abierta redactada preparada traducida comprobada reenviada".split(),
    "de": "geprüft geschrieben verfasst freigegeben erstellt gemeldet eingereicht unterzeichnet bearbeitet gesendet weitergeleitet übersetzt beantragt geöffnet".split(),
}
# What a person does, after the name.
ACTS = frozenset("reviewed approved wrote signed said asked replied called lives joined explained answered noted reported forwarded hat habite vive firmó escribió dijo schrieb wohnt sagte a-t-il signe écrit demande".split())
# Capitalised words that name things, groups and roles rather than persons.
NOT_PERSONS = frozenset(
    """
    team group support service services system department office sales engineering data platform network cloud server client engine software project
    company corporation inc corp ltd gmbh llc foundation university institute college school bank hospital committee council board agency ministry
    association union center centre lab labs library api sdk database index query search worker manager parser schema default admin administrator
    root user users test guest service account customer customers public private general new old main first last open source apache google amazon
    microsoft oracle java python linux windows street road monday tuesday wednesday thursday friday saturday sunday january february march april
    may june july august september october november december the all any our your their its this that these those please see note todo
    """.split()
)
# What marks a street in the languages of the corpus.
STREETS = """
    street st. road rd. lane court ct. avenue ave. ave crescent drive terrace square boulevard blvd. close way rue allée impasse
    chemin quai calle avenida avda. plaza paseo camino straße strasse str. weg platz gasse allee ring damm ufer
    """.split()
# Signs between the name and the host of an address, plain and disguised.
AT_SIGNS = ["@", "(at)", "[at]", "{at}", "<at>", " at "]
# Words that announce a telephone number, and an identity number.
PHONE_CUES = "phone telephone tel tel. tél tél. teléfono téléphone telefon fon mobile mobil móvil portable handy cell fax call ring whatsapp hotline rückruf callback appeler llamar anrufen".split()
ID_CUES = """
    ssn|social security|dni|nie|nino|nif|steuernummer|steuer-id|steueridentifikationsnummer|identity number|identity no|national id|national identity|national insurance|id number|id no|id
    |numéro de sécurité|sécurité sociale|nir|insee|tax id|personal number|passport|ausweisnummer|número de identidad|documento
    """.replace("\n", "").split("|")
ADDRESSED, FIELDS, ID_CUES = ([w.strip() for w in words] for words in (ADDRESSED, FIELDS, ID_CUES))

_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9_])(?!-[A-Za-z0-9])")
_DOT = r"(?:\s?[(\[{]dot[)\]}]\s?|\sdot\s|\.)"
_HIDDEN = re.compile(rf"[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9_])", re.I)
_SPOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]*(?:\sdot\s[A-Za-z0-9][A-Za-z0-9-]*)*\sdot\s[A-Za-z]{2,24}(?![A-Za-z0-9_])", re.I)

#: Numbers by the shapes of numbering plans, read where one begins. A match is neither part of a longer word nor of a longer number.
_NUMBER = re.compile(
    r"(?<![\w.@#/\\-])(?:"
    r"(?P<phone>"
    r"\+\d{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?\d{1,11}){1,6}"  # international with sign
    r"|00[1-9]\d{0,2}(?:[ ./-]\d{1,7}){2,6}"  # international with 00
    r"|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}\.\d{3}\.\d{4}|(?:1-)?\d{3}-\d{3}-\d{4}"  # three, three, four
    r"|0[1-9](?P<s>[ .-])\d\d(?:(?P=s)\d\d){3}"  # five pairs
    r"|0[1-9]\d{3} \d{3} ?\d{3}"  # area code of five
    r"|01[567]\d[ /-]?\d{7,8}"  # mobile, area code of four
    r"|\(0[1-9]\d{1,4}\) ?\d{3,4}(?:[ -]?\d{3,4}){1,2}|0[12]\d \d{4} \d{4}"  # area code in brackets, or of three
    r"|\(?0[1-9]\d{1,4}\)?(?:/| / |-)\d{4,9}(?:-\d{1,4})?"  # area code, stroke, number
    r")|(?P<national_id>"
    r"\d{3}(?P<t>[- ])\d\d(?P=t)\d{4}"  # three, two, four
    r"|[A-Z]{2}(?P<u> ?)\d\d(?P=u)\d\d(?P=u)\d\d(?P=u)[A-Z]"  # two letters, six digits, a letter
    r"|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"  # eight and a check letter
    r"|\d \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?"  # sex, year, month, department, commune, order
    r"|\d{3} \d{3} \d{3} \d\d|\d\d \d{3} \d{3} \d{3}"  # eleven digits
    r")|(?P<plain>\d{7,15}|0[1-9]\d{1,4} \d{5,8}))(?!\w)(?![./-]\d)"
)
#: An account number in groups (its validity is tested), and a payment card.
_ACCOUNT = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\w)")
#: What may stand between a cue and what it announces.
_GAP = re.compile(r"[.]?[\"')\]]?(?:\s?\([^\W\d_]+\))?\s{0,2}(?:(?:number|no|nummer|numéro|número|is|ist|est|es|lautet)\.?\s)?[:=#(\[]?\s{0,2}[\"'(\[<]?")

_W = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_ADDRESS = re.compile(
    rf"(?<!\w)(?:"
    rf"\d{{1,5}} ?[a-zA-Z]?,? (?:{_W} ){{1,3}}(?:Street|St\.|St\b|Road|Rd\.|Lane|Court|Ct\.|Avenue|Ave\.|Ave\b|Crescent|Drive|Terrace|Square|Boulevard|Blvd\.|Close|Way)(?:,? (?:Apt|Apartment|Flat|Unit|Suite|No)\.? ?\w+)?"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|quater|[a-z]))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)(?: (?:de la|de l['’]|du|des|de|d['’]))? ?{_W}(?: {_W})*"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino)(?: (?:de la|de los|de las|del|de))? {_W}(?: {_W})*,? (?:n\.?º ?)?\d{{1,4}}(?: ?[a-z]\b)?(?:,? \d{{1,2}} ?[ºª°](?: ?[A-Z]\b)?)?"
    rf"|(?:(?:Am|An der|An dem|Im|In der|Zum|Zur|Auf der|Auf dem) )?{_W}(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer| Straße| Weg| Platz| Allee) \d{{1,4}}(?: ?[a-z]\b)?"
    rf")",
)
_PART = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
#: What may stand between given and family name.
_PARTICLES = r"(?: (?i:van|von|vom|zu|zum|zur|ter|ten|af|av|di|da|do|dos|das|del|della|dello|des|du|de|bin|ibn|al|el|der|den)(?: (?i:der|den|dem|het|la|las|los|le|el))?)?"
_NAME = rf"({_PART})((?: [^\W\d_]\.)*)(?:{_PARTICLES}) (?:[dl]['’](?=[A-ZÀ-ÖØ-Þ]))?({_PART})"
_GIVEN_FIRST = re.compile(_NAME)
_GIVEN_FIRST_PLAIN = re.compile(rf"({_PART})((?: [^\W\d_]\.)*) ({_PART})")
_FAMILY_FIRST = re.compile(rf"({_PART}), ({_PART})((?: [^\W\d_]\.)*)")
_ONE = re.compile(rf"(?:{_PARTICLES[:-1].replace('(?: ', '(?:', 1)} )?({_PART})(?![\w@-])")
#: Between a name and a contact detail of the person: marks and at most two words that say what comes.
_BRIDGE = re.compile(r"[\"')\]]*[\s,;:|(<\[]+(?:[\"']?[^\W\d_]{1,14}[-.:]?[\"']?\s*[:=]?\s*[\"'<(\[]*){0,2}")
_WORD = re.compile(r"[^\W_]+")
#: Between the members of a list of persons, and of a list or row of numbers.
_AND = re.compile(r",? (?:and|und|et|y|e|or|oder|ou|o|&) |[,;] ")
_BETWEEN = frozenset(("", ";", "|", ",", "or", ", or", "and", "oder", "und", "ou", "et", "o", "y"))
#: Words of two letters that aren't family names.
_SHORT_WORDS = frozenset("ai al am an as at au by ci da db de do du ed el em en er es et ex go he id if im in io ip is it la le lo me my na no ob of ok on or os ou qa se si so su tu ui um un up us va vm vs we zu".split())
#: Common words that are no part of a name, also where they are capitalised.
_WORDS_NOT_NAMES = frozenset("is ist est and the for from with this that before after when while who has have had was were will can must should avant pour dans avec sur une les des und der die das den mit von bei hat wird para por con que los las una del".split()) | NOT_PERSONS | {w for cue in (*PHONE_CUES, *ID_CUES, *FIELDS, *STREETS) for w in cue.split()}


@lru_cache(maxsize=1)
def _automaton():
    """Cues, signs, titles, streets, given names and the beginnings of numbers; a hit is (kinds, length)."""
    import ahocorasick

    own = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for kind, words in (("street", STREETS), ("title", TITLES), ("given", GIVEN_NAMES), ("at", AT_SIGNS), ("addressed", ADDRESSED), ("field", FIELDS), ("agent", AGENTS), ("phone", PHONE_CUES), ("id", ID_CUES), ("act", ACTS)):
        for w in words:
            kinds.setdefault(_folded(w), set()).add(kind)
    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    # A digit is where a number begins if what is before it can't be inside one; letters may belong to an identity number.
    for before in " \t\r\n,;:=\"'`([{<>|+*_!?#~%&^$" + "\u00a0\u2013\u2014\u201c\u201d\u201e\u2018\u2019\u00ab\u00bb":
        for d in digits:
            kinds.setdefault(before + d, set()).add("number")
    for before in letters:
        for d in [*digits, *([" " + x for x in digits]), *(["-" + x for x in digits] if before in "xyz" else [])]:
            kinds.setdefault(before + d, set()).add("letters")
    for w, k in kinds.items():
        own.add_word(w, (frozenset(k), len(w)))
    own.make_automaton()
    return own


def _lower(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _folded(low: str) -> str:
    """Letters without their accents, each in its place; those that aren't a letter with accents stay."""
    if low.isascii():
        return low
    return "".join(c if c.isascii() else next((b for b in unicodedata.normalize("NFD", c)[:1] if b.isascii() and b.isalpha()), c) for c in low)


def _email(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The address around the at-sign text[a:b], or None: to both sides as far as the grammar goes."""
    sign = text[a:b]
    end = a
    if sign != "@":
        while end > 0 and text[end - 1] == " ":
            end -= 1
        while b < len(text) and text[b] == " ":
            b += 1
        if a - end > 1:
            return None
    start = end
    while start > 0 and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
        start -= 1
    while start < end and not text[start].isalnum():
        start += 1
    if start == end or not (text[end - 1].isalnum() or text[end - 1] in "_+-"):
        return None
    host = (_HOST if sign == "@" else _SPOKEN if sign.strip().isalpha() else _HIDDEN).match(text, b)
    return (start, host.end()) if host else None


class _Found:
    """Findings in order of place, without overlaps."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> bool:
        """Adds a finding; False if the place is taken."""
        i = bisect_left(self.starts, a)
        if i < len(self.starts) and self.starts[i] < b or i and self.spans[i - 1][1] > a:
            return False
        self.starts.insert(i, a)
        self.spans.insert(i, (a, b, kind))
        return True

    def after(self, a: int) -> tuple[int, int, str] | None:
        i = bisect_left(self.starts, a)
        return self.spans[i] if i < len(self.spans) else None

    def before(self, a: int) -> tuple[int, int, str] | None:
        i = bisect_left(self.starts, a)
        return self.spans[i - 1] if i else None


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid_identity(value: str) -> bool:
    """Whether a number of one of the shapes passes the check of its country: ranges, or a check digit or letter."""
    bare = re.sub(r"[^0-9A-Z]", "", value)
    if m := re.fullmatch(r"(\d{3})[- ](\d\d)[- ](\d{4})", value):
        return m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-Z]", bare):
        return bare[0] not in "DFIQUV" and bare[1] not in "DFIOQUV" and bare[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ") and bare[8] in "ABCD"
    if re.fullmatch(r"[XYZ\d]\d{7}[A-Z]", bare):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:8].translate(str.maketrans("XYZ", "012"))) % 23] == bare[8]
    if re.fullmatch(r"[12]\d{14}", bare):
        return 97 - int(bare[:13]) % 97 == int(bare[13:])
    if re.fullmatch(r"[1-9]\d{10}", bare):
        product = 10
        for c in bare[:10]:
            product = ((int(c) + product) % 10 or 10) * 2 % 11
        return (11 - product) % 10 == int(bare[10])
    return False


def _valid_account(value: str) -> bool:
    bare = value.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _style(word: str) -> int:
    """1 for small letters, 2 for capitals, 3 for a capital first, in each part; 0 otherwise."""
    parts = [p for p in re.split(r"['’-]", word) if p]
    if all(p.islower() for p in parts):
        return 1
    if len(word) > 1 and word.isupper():
        return 2
    if word[0].isupper() and not word.isupper() and all(p[0].isupper() or p.islower() and "-" in word for p in parts):
        return 3
    return 0


def _can_be(word: str, style: int, least: int = 2) -> bool:
    """Whether a word can be a part of a name: of two letters only with a capital, and no common word."""
    low = word.lower()
    return low not in _WORDS_NOT_NAMES and len(word) >= least and (len(word) >= 3 or style > 1 and low not in _SHORT_WORDS)


def _ends(text: str, end: int) -> bool:
    """Whether a name can end here: no identifier, call or assignment goes on."""
    return not (end < len(text) and (text[end] in "_@=" or text[end].isalnum()))


def _name(text: str, a: int) -> tuple[int, int, bool, bool] | None:
    """(end, style, family name first, with particles) of the name that begins at `a`, or None."""
    for pattern in (_GIVEN_FIRST, _GIVEN_FIRST_PLAIN):
        m = pattern.match(text, a)
        if m:
            style = _style(m.group(1))
            # In small letters, particles are ordinary words.
            if style and (style > 1 or pattern is _GIVEN_FIRST_PLAIN) and _style(m.group(3)) == style and _can_be(m.group(1), style) and _can_be(m.group(3), style) and _ends(text, m.end()):
                return m.end(), style, False, m.start(3) > m.end(2) + 1
    m = _FAMILY_FIRST.match(text, a)
    if m:
        style = _style(m.group(1))
        if style and _style(m.group(2)) == style and _can_be(m.group(1), style) and _can_be(m.group(2), style) and _ends(text, m.end()):
            return m.end(), style, True, False
    return None


def _word_starts(text: str, a: int, most: int) -> list[int]:
    """Where the word at `a` and the `most` words before it in its line begin, the nearest first."""
    out = []
    at = a
    while at >= 0 and len(out) <= most:
        while at > 0 and text[at - 1].isalnum():
            at -= 1
        out.append(at)
        at -= 1
        while at >= 0 and not text[at].isalnum():
            if text[at] in "\r\n":
                return out
            at -= 1
    return out


def _whole(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] isn't inside a longer word."""
    return not (a and text[a].isalnum() and (text[a - 1].isalnum() or text[a - 1] in "_@.+/\\")) and not (b < len(text) and text[b - 1].isalnum() and (text[b].isalnum() or text[b] in "_@"))


def _announced(text: str, low: str, hits: list, kind: str) -> set[int]:
    """The places that a cue announces: right behind it, but for what may stand between."""
    out = set()
    for a, b, kinds in hits:
        if kind in kinds and _whole(low, a, b):
            end = _GAP.match(text, b).end()
            out.add(end)
            if text[end - 1] in "([<":
                out.add(end - 1)
    return out


def _numbers(text: str, low: str, hits: list, found: _Found) -> list[tuple[int, int, str]]:
    """Telephone and identity numbers from where numbers begin: by shape, and for the latter by a cue or a check.

    Returned are those with the shape of an identity number only.
    """
    phones, ids = (_announced(text, low, hits, kind) for kind in ("phone", "id"))
    blocked = 0
    loose: list[tuple[int, int, str]] = []
    begun = sorted({a + 1 - (text[a + 1 : a + 2].isdigit() and text[a] in "+(") for a, _, kinds in hits if "number" in kinds} | {x for a, b, kinds in hits if "letters" in kinds for x in (a, a - 1) if x >= 0})
    begun = sorted({*begun, *(x - 1 for x in begun if x and text[x - 1] in "+(")} | ({0} if text[:1].isdigit() or text[:1] in "+(" else set()))
    for at in begun:
        if at < blocked:
            continue
        if text[at].isalpha():
            if not text[at].isupper():
                continue
            m = _ACCOUNT.match(text, at) if not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) else None
            if m and _valid_account(m.group()):
                blocked = m.end()
                continue
        elif (m := _CARD.match(text, at)) and 13 <= sum(c.isdigit() for c in m.group()) <= 19 and _luhn(re.sub(r"\D", "", m.group())):
            blocked = m.end()
            continue
        m = _NUMBER.match(text, at)
        if not m:
            continue
        digits = sum(c.isdigit() for c in m.group())
        if m.group("phone"):
            if 9 <= digits <= 16:
                found.add(*m.span(), "phone")
        elif m.group("national_id"):
            if at in ids or valid_identity(m.group()):
                found.add(*m.span(), "national_id")
            else:
                loose.append((*m.span(), "national_id"))
        elif digits >= 9 and at in ids and " " not in m.group():
            found.add(*m.span(), "national_id")
        elif at in phones:
            found.add(*m.span(), "phone")
    return loose


def _rows(text: str, loose: list[tuple[int, int, str]], found: _Found) -> None:
    """Adds the numbers that are next to a finding in a row of fields or a list."""
    for a, b, kind in loose:
        left, right = found.before(a), found.after(b)
        if left and text[left[1] : a].strip(" \"'").lower() in _BETWEEN and (left[2] == kind or text[left[1]] in ";|\t,") or right and text[b : right[0]] in (";", "|", "\t", ", ", ","):
            found.add(a, b, kind)


def _addresses(text: str, hits: list, found: _Found) -> None:
    """Street addresses: from the street word back to where one may begin, then forward by the grammar."""
    done = 0
    for a, _, kinds in hits:
        if "street" in kinds and a >= done:
            for start in reversed(_word_starts(text, a, 6)):
                m = _ADDRESS.match(text, start)
                if m and a < m.end() and not ("\n" in m.group() or "\r" in m.group()) and found.add(*m.span(), "address"):
                    done = m.end()
                    break


def _persons(text: str, low: str, hits: list, found: _Found) -> None:
    """Names: after titles, cues and fields, beside contact details, before what persons do, or by a common given name.

    In small letters two words could be anything, so there the sign has to be a strong one.
    """

    def linked(end: int) -> bool:
        """Whether a contact detail follows."""
        then = found.after(end)
        return bool(then and then[2] != "person" and _BRIDGE.fullmatch(text, end, then[0]))

    def closed(end: int) -> bool:
        """Whether a clause or a line ends here."""
        return end == len(text) or text[end] in ".,;:)\"'\r\n<("

    def acts(end: int) -> bool:
        return text[end : end + 1] == " " and (m := _WORD.match(low, end + 1)) is not None and m.group() in _ACTS

    def skip(at: int, marks: str) -> int:
        while at < len(text) and text[at] in marks:
            at += 1
        return at

    for a, b, kinds in hits:
        if not kinds & _OF_PERSONS or not _whole(low, a, b):
            continue
        cue = low[a:b]
        if "title" in kinds and (text[a].isupper() or cue in _SMALL_TITLES) and not (cue == "m." and _initial(text, a)) and (at := skip(b, " ")) > b:
            own = _name(text, at)
            if own and (own[1] > 1 or cue[-1] == "." or acts(own[0]) or linked(own[0])):
                found.add(at, own[0], "person")
            elif (m := _ONE.match(text, at)) and len(m.group(1)) > 1 and _style(m.group(1)) == 3 and m.group(1).lower() not in _TITLE_WORDS:
                found.add(at, m.end(), "person")
        if "addressed" in kinds:
            at = skip(b, " :\r\n" if cue[-1] == "," else " :")
            if m := _IS.match(low, at):
                at = m.end()
            own = _name(text, at) if at > b else None
            if own and (own[1] > 1 or linked(own[0]) or (" " in cue or cue.startswith("att")) and closed(own[0])):
                found.add(at, own[0], "person")
        if "field" in kinds:
            at = skip(b, "\"' ")
            if at < len(text) and text[at] in ":=(":
                at = skip(at + 1, " \"'")
            own = _name(text, at) if at > b else None
            if own and (linked(own[0]) or text[b : b + 1] != " " and (own[1] > 1 or cue in WRITERS)):
                found.add(at, own[0], "person")
        if "agent" in kinds and text[b : b + 1] == " ":
            begin = _word_starts(text, a - 2, 0)[0] if a > 1 and text[a - 1] == " " else a
            own = _name(text, b + 1)
            if own and (low[begin : max(begin, a - 1)] in _DEEDS[AGENTS[cue]] and (own[1] > 1 or closed(own[0])) or own[3] or linked(own[0])):
                found.add(b + 1, own[0], "person")
        if "act" in kinds and a > 3 and text[a - 1] == " ":
            for start in _word_starts(text, a - 2, 3):
                own = _name(text, start)
                if own and own[0] == a - 1 and own[1] == 3 and (start == 0 or text[start - 1] == "\n" or text[start - 2 : start] in (". ", "! ", "? ")):
                    found.add(start, own[0], "person")
        if "given" in kinds:
            start = a
            if text[a - 2 : a] == ", ":
                start = _word_starts(text, a - 3, 0)[0] if a > 2 else a
            elif a and text[a - 1] == "-":
                start = _word_starts(text, a - 2, 0)[0] if a > 1 else a
            for at in (start, a) if text[a - 1 : a] != "-" else (start,):
                own = _name(text, at) if _whole(text, at, b) else None
                if own and own[2] == (at < a and text[a - 1] == " ") and (own[1] > 1 or linked(own[0])) and found.add(at, own[0], "person"):
                    break
    for start, _, kind in list(found.spans):
        if kind != "person":
            _beside(text, start, found)
    _listed(text, found)


def _initial(text: str, a: int) -> bool:
    """Whether what begins at `a` follows a capitalised word, such as the initial between two names."""
    return a > 1 and text[a - 1] == " " and text[a - 2].isalnum() and text[_word_starts(text, a - 2, 0)[0]].isupper()


def _beside(text: str, at: int, found: _Found) -> None:
    """A name that ends right before a contact detail at `at`; in small letters if it is a field or a line of its own, or in the address."""
    for start in _word_starts(text, at - 1, 7) if at else ():
        if start == at or start and text[start - 1] in "-'’_@.+/\\":
            continue
        own = _name(text, start)
        if not own or own[0] > at or not _BRIDGE.fullmatch(text, own[0], at):
            continue
        alone = (start == 0 or text[start - 1] in "\r\n;|\t" or text[start - 2 : start] == ": ") and all(c in " ;|,<([" for c in text[own[0] : at])
        if own[1] > 1 or alone or _corroborated(text, start, own[0], found.after(at)):
            found.add(start, own[0], "person")
            return


def _corroborated(text: str, a: int, b: int, item: tuple[int, int, str]) -> bool:
    """Whether an e-mail address has the parts of the name text[a:b]."""
    address = _folded(text[item[0] : item[1]].lower())
    return item[2] == "email" and all(p in address for p in _WORD.findall(_folded(text[a:b].lower())) if len(p) > 1)


def _listed(text: str, found: _Found) -> None:
    """The names that follow a name in a list."""
    todo = [end for _, end, kind in found.spans if kind == "person"]
    while todo:
        m = _AND.match(text, todo.pop())
        own = _name(text, m.end()) if m else None
        if own and own[1] > 1 and not (m.group()[0] == "," and own[2]) and found.add(m.end(), own[0], "person"):
            todo.append(own[0])


_IS = re.compile(r"(?:is|ist|est|es) ")
_OF_PERSONS = frozenset(("title", "addressed", "field", "agent", "act", "given"))
_DEEDS = {language: frozenset(map(_folded, words)) for language, words in DEEDS.items()}
_ACTS = frozenset(map(_folded, ACTS))
#: Titles that are written in small letters as well, and stand before nothing but names.
_SMALL_TITLES = frozenset(map(_folded, ("señor", "señora", "monsieur", "madame")))
_TITLE_WORDS = frozenset(t.rstrip(".") for t in TITLES)


def find_personal(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information of a text, by position, without overlaps.

    E-mail addresses come first, also disguised ones; names within them do not count. Then numbers from
    where numbers begin, street addresses, and names. Positions are code points.
    """
    if not text:
        return []
    low = _folded(_lower(text))
    hits = [(end - n + 1, end + 1, kinds) for end, (kinds, n) in _automaton().iter(low)]
    found = _Found()
    for a, b, kinds in hits:
        if "at" in kinds and (span := _email(text, a, b)):
            found.add(*span, "email")
    loose = _numbers(text, low, hits, found)
    _addresses(text, hits, found)
    _rows(text, loose, found)
    _persons(text, low, hits, found)
    return found.spans


def redact_text(text: str | None) -> str | None:
    """The text with each finding replaced by the placeholder of its kind."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_personal(text):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


FOUND = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("value", pa.string())])


def personal_information(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, value): every finding in every document.

    An automaton with at-signs, titles, cues, street words, common given names and the beginnings of
    numbers goes over each text once; parsers expand the places it finds, as far as their grammar goes. Whole texts are read. Null and empty texts give no row,
    a repeated document gives its rows again, and other columns are ignored. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0).to_pylist(), []
            for i, t in zip(ids, batch.column(1).to_pylist()):
                spans.extend((i, kind, a, b, t[a:b]) for a, b, kind in find_personal(t))
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*spans), FOUND)], schema=FOUND)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, kind string, start_pos int, end_pos int, value string")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): every text with typed placeholders for personal information, otherwise unchanged."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact_text(t) for t in batch.column(1).to_pylist()], pa.string())], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, text string")
