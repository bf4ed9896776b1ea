"""Candidate spans of personal data and the labelers that vote on them.

Everything here works on one text with the standard library and ``regex``; see ``pii`` for the
distributed part. A candidate is (kind, start, end, form, votes, features); votes are +1, -1 or 0, one
per labeler of the kind, in the order of ``LABELERS``.
"""

from __future__ import annotations

import re as stdre
from dataclasses import dataclass

import regex as re

KINDS = ("email", "phone", "id_number", "address", "person")
LABELERS = {
    "email": ("form", "domain", "cue", "code"),
    "phone": ("layout", "cue", "digits", "foreign_cue", "other_number"),
    "id_number": ("form", "cue", "foreign_cue", "other_number", "field"),
    "address": ("type", "cue", "name", "number", "tail"),
    "person": ("cue", "after", "given", "family", "common", "shape"),
}

# Words and patterns of the languages that occur in such texts.
ID_CUE = (
    r"ssn|social[ _-]security(?:[ _]number| no\.?)?|soc\.? ?sec\.?|passport(?:[ _]no)?|reisepass(?:nummer)?|passeport|pasaporte|travel document"
    r"|nir|num[ée]ro de s[ée]curit[ée] sociale|n[°º] de s[ée]curit[ée] sociale|s[ée]curit[ée] sociale|n[úu]mero de seguridad social"
    r"|steuer-?(?:id|nummer|identifikationsnummer)|steuerliche id|tax(?:payer)?[ _-]?(?:id|identification|number|no\.?)|tin"
    r"|national[ _-](?:id|identity)(?: card| number| no\.?)?|identity(?: card)?|id[ _-](?:card|number|no\.?)|personal(?:ausweis|nummer| id)(?:nummer)?|ausweis(?:nummer)?"
    r"|dni|nie|nif|documento(?: nacional)? de identidad|nino|ni number|ni no\.?|ni|national insurance"
    r"|driver'?s? licen[cs]e|driving licen[cs]e|паспорт|инн|снилс|マイナンバー|個人番号|旅券番号|パスポート"
)
ID_TAIL = r"(?:\s?(?:number|nummer|no\.?|nr\.?|num\.?|n[°º]|card|#|id|номер))*[\"'`]?\s?(?:is|was|est|ist|es|lautet|[:=>#：\t])*\s?[\"'`]?\s?"
PHONE_CUE = (
    r"on-?call|tel|tél|telefon|teléfono|telephone|téléphone|phone|mobile|mobil|cell|fax|call(?: me)?(?: on| at)?|ring|whatsapp|hotline|handy|"
    r"appelez(?:-moi)?(?: le| au)?|ruft mich an|anrufen|llámame|móvil|portable|телефон|тел|звоните|電話|携帯|contact|sms|text|dial|reach me"
)
NOT_PERSONAL = (
    r"box|ticket|lot|slide|barcode|accession|epoch|hash|commit|job|node|build|release|version|doi|rows?|chr\w+|sha\d*|"
    r"batch|serial(?: number| no\.?)?|s/n|order|part|file|issue|bug|pr|port|pid|device|sample|item|row|line|isbn|run|step|size|seed|rev"
)
STREET_TYPE = (
    r"street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|boulevard|blvd|square|sq|terrace|ter|crescent|cres|close|way|row|place|pl|"
    r"parkway|pkwy|highway|hwy|mews|gardens|grove|hill|walk|alley|circle|cir|trail|quay"
)
COMPASS = r"north|south|east|west|northeast|northwest|southeast|southwest|n|s|e|w|ne|nw|se|sw"
FRENCH_TYPE = r"rue|avenue|av\.|boulevard|bd|impasse|place|chemin|allée|quai|route|cours|square|passage|ruelle|faubourg"
SPANISH_TYPE = r"calle|c/|avenida|avda\.?|av\.|plaza|pl\.|paseo|pº|camino|carretera|ronda|travesía"
GERMAN_TAIL = r"straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm|berg|chaussee|steig|pfad"
ADDRESS_CUE = (
    r"(?:ship_to|addr|street|address|adresse)[\"'>]?\s?[:=\t]?\s?[\"'`]?|live at|living at|lives at|pick-?up (?:is )?at|ship (?:\w+ ){0,3}to|deliver (?:\w+ ){0,3}to|send (?:\w+ ){0,3}to|(?:came|went|moved|drive|drove|sent|goes|go) to|address(?: is)?:?|"
    r"住所[:：]?|адрес:?|wohne?n? (?:in|an)?|proben bitte an|bitte an|anschrift:?|adresse:?|habite(?: au)?|au|chez|env[íi]en (?:\w+ ){0,2}a|vivo en|dirección:?|visit \w+ at|based at|office at|located at|domicile:?"
)
PARTICLE = r"van der|van den|von der|de la|de los|van|von|de|der|den|di|da|du|del|la|le|al|bin|ibn|ter|zu|af"
TITLE = r"dr|prof|mr|mrs|ms|mx|mme|mlle|m|frau|herr|señora|señor|sra|sr|doctora|doctor|docteur|professor|professeur"
ROLE = (
    r"colleague|coworker|co-worker|collaborator|supervisor|advisor|adviser|boss|manager|postdoc|technician|nurse|student|intern|friend|neighbou?r|"
    r"teacher|partner|wife|husband|son|daughter|brother|sister|mother|father|director|engineer|editor|author|reviewer|patient|kollegin|kollege|"
    r"collègue|compañer[oa]|amig[oa]|freundin|freund|коллега"
)
PERSON_CUE = (
    r"(?:dr|prof|mr|mrs|ms|mx|mme|mlle|sra|sr)\.|frau|herr|herrn|señora?|la doctora|el doctor|doctora?|professor|patient(?:in)?|"
    r"thanks,|thank you,|regards,|wishes,?|cheers,|best,|sincerely,|cc:|cc|from:|to:|by:|ask|author:|maintainer:|maintained by|contact:|owner:|name:|reviewed by|"
    r"written by|signed by|sent by|signed-off-by:|co-authored-by:|reported-by:|laut|según|d'après|d’après|selon|demandez à|demandez a|saludos,|viele grüße,|mit freundlichen grüßen,|"
    r"cordialement,|met|called|emailed|contacted|asked|told|thank|(?:my|our|your|his|her|their|the|a|former|new|old) (?:ROLE)|"
    r"as|--|автор:|с уважением,|спросите,|спросите|担当[:：]|(?:author|owner|name|contact|assignee|maintainer|user|operator|reviewer|submitter)[^\w\n]{1,5}"
).replace("ROLE", ROLE)
PERSON_AFTER = (
    r"signed|and i\b|said|says|wrote|writes|who\b|works?\b|worked|fixed|left\b|sent|called|joined|replied|answered|noticed|found|confirmed|had\b|has\b|told|asked|reported|"
    r"knows|thinks|suggested|mentioned|wants|uses|used|will\b|can\b|<|さん|です。よろしく|氏|様|hat\b|sagt|schrieb|meint|weiß|a dit|dit\b|écrit|dice|dijo|escribió|говорит|сказал|написал|знает"
)
#: Fixed: function words that are never part of a name or street, in the languages of the texts.
FUNCTION_WORDS = frozenset(
    """the a an and or but if then than that this these those of in on at to for from by with without as is are was were be been
    it its he she we you i they them his her our your their not no yes all any some each every other another same more most less
    very only also just even still again ever never before after while when where why how what which who whom whose there here
    over under into onto about between through during above below up down out off near per via see use using used get got have has
    had do does did done will would can could should may might must shall let run runs takes take took
    le la les un une des du de et ou mais si que qui dans sur pour par avec sans est sont ce cette ces pas plus il elle nous vous
    der die das ein eine und oder aber wenn dann als dass von zu mit ohne ist sind nicht kein auch nur noch bei aus nach vor
    el los las y o pero si que en con sin para por es son no más del al se lo su
    и или но если что в на с для по от до не как это
    samples minutes rows lines files batches donors segments tracks copies times percent days hours seconds""".split()
)

_F = re.IGNORECASE
_WORD = r"[^\W\d_]"
_LAT = "A-Za-z0-9À-ɏ"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
EMAIL_PLAIN = re.compile(rf"(?<![{_LAT}._%+\-])[{_LAT}][{_LAT}._%+\-]*+[@＠]{_LABEL}(?:\.{_LABEL}){{1,6}}", _F)
_AT = r"[\(\[{<](?:at|ät|arroba|a)[\)\]}>]"
BRACKETED_AT = re.compile(_AT, _F)
EMAIL_WORDS = re.compile(
    rf"(?<![{_LAT}._%+\-])[{_LAT}][{_LAT}._%+\-]*+(?:\s?{_AT}\s?| at )"
    rf"{_LABEL}(?:(?:\s?[\(\[{{<](?:dot|punkt|point|punto)[\)\]}}>]\s?| dot |\.){_LABEL}){{1,6}}",
    _F,
)
EMAIL_SPACED = re.compile(
    rf"(?<![{_LAT}._%+\-])[{_LAT}][{_LAT}._%+\-]*+ ?[@＠] ?{_LABEL}(?: ?\. ?{_LABEL}){{0,5}} ?\. ?[A-Za-z]{{2,10}}(?![A-Za-z0-9])", _F
)
_SEP = r"[     .\-‐-–/]"
NUMBER_RUN = re.compile(rf"(?<![A-Za-z0-9_])(?:\+ ?\d|\(\+?\d|\d)(?:\d|{_SEP}(?=[\d(])|\((?=\d)|\)(?={_SEP}?\d)){{7,24}}(?<=\d)")
S = r"[    .\-‐-–/]"
PHONE_LAYOUT = re.compile(
    rf"(?:(?:\+1|001|1){S}?)?(?:\(\d{{3}}\)|[2-9]\d{{2}}){S}?\d{{3}}{S}?\d{{4}}"
    rf"|(?:\+|00)(?:[2-9]\d){S}?(?:\(0\))?{S}?\d{{1,5}}(?:{S}?\d{{2,8}}){{1,4}}"
    rf"|\(0\d{{1,4}}\){S}?\d{{3,4}}{S}?\d{{2,4}}(?:{S}?\d{{2,4}})?"
    rf"|0\d(?:{S}?\d{{2}}){{4}}|0\d{S}\d{{4}}{S}\d{{4}}|0\d{{2,4}}{S}\d{{2,8}}(?:{S}\d{{2,5}}){{0,3}}|0\d{{9,10}}"
)
STRONG_LAYOUT = re.compile(rf"\+.*|00\d.*|\(\d{{2,5}}\).*|\d{{3}}{S}\d{{3}}{S}\d{{4}}|1{S}\d{{3}}.*")
_D = r"[\-‐-–. ]"
ID_FORM = re.compile(
    r"(?:(?P<nir>\d(?: ?\d{2}){3} ?\d{3} ?\d{3} ?\d{2})"
    rf"|(?P<ssn>\d{{3}}{_D}?\d{{2}}{_D}?\d{{4}})"
    r"|(?P<long>\d{3}-\d{4}-\d{5})"
    r"|(?P<steuer>\d{2} ?\d{3} ?\d{3} ?\d{3})"
    r"|(?P<dni>\d{2}\.?\d{3}\.?\d{3}(?:[- ]?[A-Z]|-?[a-z]))"
    r"|(?P<nie>[XYZxyz][- ]?\d{7}[- ]?[A-Za-z])"
    r"|(?P<passport>[A-Za-z]{1,2} ?\d{6,8})"
    r"|(?P<nino>[A-Za-z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-Da-d]))(?![\w\-])"
)
#: Where one of the forms may begin: all have six digits with at most one separator between two.
ID_START = re.compile(r"(?<![\w.\-+])(?=[A-Za-z]{0,2}[ \-]?\d(?:[\-‐-–. ]?\d){5})")
ID_LABELLED = re.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:{ID_CUE}){ID_TAIL}([A-Za-z]{{0,3}}[ \-]?\d(?:[A-Za-z0-9]|[ .\-‐-–/](?=\d)){{4,20}}(?:[ \-]?[A-Za-z](?![\p{{L}}\p{{N}}]))?)", _F
)
#: Words, or parts of words, of which every cue of an identity number has one.
ID_WORDS = frozenset(
    """ssn social soc sociale passport passeport pasaporte document nir seguridad tax taxpayer tin national identity id dni nie nif documento
    nino ni driver drivers driver's driving паспорт инн снилс""".split()
)
ID_PARTS = ("teuer", "TEUER", "ersonal", "ERSONAL", "usweis", "USWEIS", "eisepass", "EISEPASS", "マイナンバー", "個人番号", "旅券番号", "パスポート")
BEFORE_ID = re.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{ID_CUE}){ID_TAIL}$", _F)
BEFORE_PHONE = re.compile(rf"(?<![\p{{L}}])(?:{PHONE_CUE})\.?(?: is| ist| es|は|\(|[:：=.<>\s\"'])*$", _F)
AFTER_PHONE = re.compile(r"^\)?\s?(?:\((?:office|mobile|home|cell|fax|work|privat|bureau|dienstlich|oficina)|ext\b|です|after|before|between|or\b)", _F)
BEFORE_OTHER = re.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{NOT_PERSONAL})[ :=#]*(?:(?:is|was|says|reads|no\.?) )?$|[A-Za-z]{{2,}}\d*[:/=]$|[#v_]$", _F)
DATE_OR_IP = re.compile(r"(?:19|20)\d\d[\-/.]\d\d?[\-/.]\d\d?(?:[ T]\d.*)?|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,4}|\d+(?:\.\d+){2,}|\d+[-–]\d+|\d+\.\d+")
FIELD = re.compile(r"[\"'<\[(]?(?:ssn|id|passport|dni|tax)[\w\-]*[\"'>\])]?\s*[:=>]\s*[\"'`]?$", _F)
_NUM = r"\d{1,5}(?:(?: ?[-–] ?)\d{1,5})?(?: ?[A-Za-z](?![\p{L}\p{N}'’.]))?"
_UP = r"[\p{L}][\p{L}'’\-]*"
ADDRESS_EN = re.compile(
    rf"(?<![\p{{L}}\p{{N}}.,\-/])({_NUM}) ((?:(?:{COMPASS})\.? )?)((?:St\. )?(?:{_UP} ){{1,3}}?)((?:{STREET_TYPE})\b\.?)((?: (?:{COMPASS})(?![\p{{L}}\p{{N}}])\.?)?)", _F
)
ADDRESS_FR = re.compile(
    rf"(?<![\p{{L}}\p{{N}}.,\-/])(\d{{1,5}}(?:[-–]\d{{1,5}})?(?: ?(?:bis|ter|quater|[A-Za-z]))?),? (?:{FRENCH_TYPE}) ((?:(?:du|de la|de l['’]|des|de|d['’]) ?)?{_UP}(?: (?-i:\p{{Lu}}){_UP}){{0,2}}?)(?![\p{{L}}'’\-])", _F
)
ADDRESS_ES = re.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:{SPANISH_TYPE})(?:(?<=[/.]) ?| )((?:(?:de la|de los|de las|del|de) )?{_UP}(?: (?!n\.?[º°])(?-i:\p{{Lu}}){_UP}){{0,2}}),? (?:n\.?[º°]\.? ?|num\.? |nº )?(\d{{1,5}}(?:[-–]\d{{1,5}})?(?: ?[A-Za-z](?![\p{{L}}\p{{N}}'’.]))?)(?![\p{{N}}])", _F
)
ADDRESS_DE = re.compile(
    rf"(?<![\p{{L}}\p{{N}}])((?:(?:am|an der|im|auf dem|zum|zur) \p{{L}}+(?: \p{{L}}+)?)|(?:\p{{L}}[\p{{L}}\-]*(?:{GERMAN_TAIL}))|(?:\p{{L}}[\p{{L}}\-]* (?:str\.|straße|strasse|allee|weg|platz|ring|gasse))) (\d{{1,5}}(?:[-–]\d{{1,5}})?(?: ?[A-Za-z](?![\p{{L}}\p{{N}}'’.]))?)(?![\p{{N}}])", _F
)
BEFORE_ADDRESS = re.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{ADDRESS_CUE})\s?$|[(]$", _F)
AFTER_ADDRESS = re.compile(r"^(?:[,.]? (?:unit|apt|suite|flat|floor|second|first|third|in \p{Lu}|\d{4,6} \p{L}|before noon|again|schicken|and can)|[.)]|$|[\r\n])", _F)
LABEL_WITHOUT_POINT = re.compile(r"(?:address|住所|anschrift|adresse|dirección)\s?[:：]\s?$|(?:ship_to|addr|street)[\"'>]?\s?[:=\t]?\s?[\"'`]?$", _F)
_TOKEN = rf"{_WORD}+(?:['’]{_WORD}+)*(?:-{_WORD}+(?:['’]{_WORD}+)*)*"
_FAMILY = rf"(?:(?:{PARTICLE}) )?{_TOKEN}"
_KANJI = r"[一-鿿々]"
TOKENS = stdre.compile(_TOKEN)
INITIAL = re.compile(rf"{_WORD}\.", _F)
PERSON_GIVEN_FIRST = re.compile(rf"({_TOKEN})((?: {_WORD}\.)?) ((?:(?:{PARTICLE}) )?)({_TOKEN})")
AFTER_PERSON = re.compile(rf"^[,.]?\s?(?:{PERSON_AFTER})", _F)
KANJI_NAME = re.compile(rf"(?<!{_KANJI})({_KANJI}{{1,4}})[ 　]({_KANJI}{{1,3}})(?!{_KANJI})|(?<!{_KANJI})({_KANJI}{{3,6}})(?=さん|氏|様|です。よろしく)|(?<=担当[:：]\s?)({_KANJI}{{3,6}})(?!{_KANJI})")


DOTTED = re.compile(r"dot|punkt|punto|point", _F)
TLD = re.compile(r"[A-Za-z0-9]+$")
BEFORE_EMAIL = re.compile(
    r"(?:mailto:|mail\w*|contact|kontakt|correo|courriel|e-?mail|メール|почта|cc|bounced|reach|write|schreib\w*|écriv\w*|escríbe\w*|to|under|with|an|by|from|owner|notify|user)"
    r"\W{0,6}(?:me |mir |moi )?(?:at |an |à |a |is )?\W{0,3}$|<$", _F
)
CODE_BEFORE = re.compile(r"[\])=]\s?$")
ANY_DIGIT = re.compile(r"\d")
DIGITS = re.compile(r"\d(?:[^\p{L}\n]?\d){5}")
HOUSE = re.compile(r"(?<![\p{L}\p{N}.,\-/])\d{1,5}(?=[ ,\-–A-Za-z])")
GERMAN_STREET = re.compile(rf"(?:{GERMAN_TAIL}|\b(?:am|an der|im|auf dem|zum|zur) \p{{L}}+(?: \p{{L}}+)?) \d", _F)
#: Parts of every German or Spanish street; a text without any is not searched for them.
GERMAN_HINTS = tuple(x.replace("\\", "") + " " for x in [*GERMAN_TAIL.split("|"), "am", "an der", "im", "auf dem", "zum", "zur"])
SPANISH_HINTS = ("calle", "c/", "avenida", "avda", "av.", "plaza", "pl.", "paseo", "pº", "camino", "carretera", "ronda", "travesía")
LAST_WORD, NEXT_WORD = re.compile(r"(\S+)\s*$"), re.compile(r"\s*(\S+)")
GERMAN_PLACE = re.compile(rf"(?:{GERMAN_TAIL}|markt|bach|hof|feld|wald|see|park|tor|hang|graben)$", _F)
STREET_NAME_HEAD = re.compile(r"^(?:(?:de la|de los|de las|du|des|del|de) |(?:de l|d)['’] ?)", _F)
AFTER_HOUSE = re.compile(r"\d[A-Za-z]? $")


@dataclass
class Lexicon:
    """What a pass over the corpus learned about words (all in casefold)."""

    given: frozenset = frozenset()
    family: frozenset = frozenset()
    common: frozenset = frozenset()


@dataclass(slots=True)
class Span:
    """``masked``: votes and features of the same span as if its names were in no gazetteer; the
    classifier is trained on both. ``scored``: the votes it sees (``votes`` where left out)."""

    kind: str
    start: int
    end: int
    form: str
    votes: tuple
    features: tuple = ()
    masked: tuple | None = None
    scored: tuple | None = None


def _last_word(s: str) -> str:
    m = LAST_WORD.search(s)
    return m.group(1).casefold()[-16:] if m else "^"


def _next_word(s: str) -> str:
    m = NEXT_WORD.match(s)
    return m.group(1).casefold()[:16] if m else "$"


def _context(t: str, a: int, b: int) -> tuple:
    """The two words on each side, and whether the span begins or ends its line."""
    before, after = t[max(0, a - 40) : a], t[b : b + 32]
    left, right = before[before.rfind("\n") + 1 :].split(), after.split("\n", 1)[0].split()
    left, right = [x.casefold()[-16:] for x in left[-2:]] or ["^"], [x.casefold()[:16] for x in right[:2]] or ["$"]
    glued = not after[:1].isspace()
    return f"prev={left[-1]}", f"prev2={' '.join(left)}", f"next={right[0]}", f"next2={' '.join(right)}", f"line={left[-1] == '^'}{right[0] == '$'}{glued}"


def _trim_brackets(t: str, a: int, b: int) -> tuple[int, int]:
    if t[a] == "(" and ")" not in t[a:b]:
        a += 1
    return a, b


def _emails(t: str, out: list[Span]) -> None:
    seen: list[tuple[int, int]] = []
    low = t.casefold()
    plans = []
    if "@" in t or "＠" in t:
        plans += [("plain", EMAIL_PLAIN), ("spaced", EMAIL_SPACED)]
    dots = " dot " in low or any(x in low for x in ("dot]", "dot)", "dot}", "dot>", "punkt", "punto", "point"))
    if BRACKETED_AT.search(t) or dots and " at " in low:
        plans.append(("words", EMAIL_WORDS))
    for form, pat in plans:
        for m in pat.finditer(t):
            a, b = m.span()
            s = t[a:b]
            if form == "words" and " at " in s.casefold() and not DOTTED.search(s):
                continue
            if any(x < b and a < y for x, y in seen):
                continue
            while s[-1] in ".-":
                s, b = s[:-1], b - 1
            seen.append((a, b))
            tld = TLD.search(s)
            tld = tld.group(0) if tld else ""
            before, after = t[max(0, a - 40) : a], t[b : b + 12]
            good = 1 if len(tld) >= 2 and tld.isalpha() else -1
            cue = 1 if BEFORE_EMAIL.search(before) else 0
            code = -1 if CODE_BEFORE.search(before) and form == "spaced" and " @ " in s and s.count(".") < 2 else (-1 if "://" in before[-30:] and len(before[before.rfind("://") :].split()) < 2 and not before[-1:].isspace() else 0)
            out.append(Span("email", a, b, form, (1 if form != "spaced" or " ." in s or s.count(".") > 1 else 0, good, cue, code), (f"tld={tld.casefold()}",)))


def _numbers(t: str, out: list[Span], words: frozenset) -> None:
    ids: dict[tuple[int, int], str] = {}
    for at in ID_START.finditer(t):
        if m := ID_FORM.match(t, at.start()):
            ids.setdefault(m.span(), m.lastgroup)
    labelled = not words.isdisjoint(ID_WORDS) or any(x in t for x in ID_PARTS)
    for m in ID_LABELLED.finditer(t) if labelled else ():
        a, b = m.span(1)
        inside = [(x, y) for x, y in ids if x >= a and y <= b or (x == a)]
        if not inside and sum(c.isdigit() for c in t[a:b]) >= 6:
            ids[(a, b)] = "labelled"
    for (a, b), form in ids.items():
        before, after = t[max(0, a - 48) : a], t[b : b + 16]
        cue = labelled and bool(BEFORE_ID.search(before))
        phone = bool(BEFORE_PHONE.search(before) or AFTER_PHONE.search(after))
        other = bool(BEFORE_OTHER.search(before)) and not cue
        fld = bool(FIELD.search(before))
        votes = (1 if form in ("nir", "long", "nino") and not other else 0, 1 if cue else -1, -1 if phone and not cue else 0, -1 if other else 0, 1 if fld or cue else 0)
        out.append(Span("id_number", a, b, form, votes, (f"form={form}", f"cue={cue}", f"prev={_last_word(before)}")))
    for m in NUMBER_RUN.finditer(t):
        a, b = _trim_brackets(t, *m.span())
        s = t[a:b]
        if s.count("(") != s.count(")"):
            continue
        n = sum(c.isdigit() for c in s)
        if not 9 <= n <= 14:
            continue
        before, after = t[max(0, a - 48) : a], t[b : b + 20]
        cue = bool(BEFORE_PHONE.search(before) or AFTER_PHONE.search(after))
        id_cue = labelled and bool(BEFORE_ID.search(before))
        if id_cue and not cue:
            continue  # an identity number by its label
        other = bool(BEFORE_OTHER.search(before)) and not cue
        odd = bool(DATE_OR_IP.fullmatch(s)) and not cue
        layout = bool(PHONE_LAYOUT.fullmatch(s))
        strong = layout and bool(STRONG_LAYOUT.fullmatch(s))
        if after[:1].isascii() and (after[:1].isalpha() or after[:1] == "_"):
            odd = True
        votes = (1 if strong else (0 if layout else -1), 1 if cue else (0 if strong else -1), 1 if 10 <= n <= 13 else 0, -1 if id_cue else 0, -1 if other or odd else 0)
        out.append(Span("phone", a, b, "strong" if strong else "layout" if layout else "run", votes, (f"strong={strong}", f"n={n}", f"cue={cue}", f"prev={_last_word(before)}")))


def _addresses(t: str, out: list[Span]) -> None:
    found = [(form, m) for at in HOUSE.finditer(t) for form, pat in (("en", ADDRESS_EN), ("fr", ADDRESS_FR)) if (m := pat.match(t, at.start()))]
    low = t.casefold()
    if any(x in low for x in SPANISH_HINTS):
        found += [("es", m) for m in ADDRESS_ES.finditer(t)]
    if any(x in low for x in GERMAN_HINTS) and GERMAN_STREET.search(t):
        found += [("de", m) for m in ADDRESS_DE.finditer(t)]
    for form, m in found:
        a, b = m.span()
        s = t[a:b]
        before = t[max(0, a - 40) : a]
        if form == "en":
            words = [w.strip(".").casefold() for w in m.group(3).split()]
            kind = m.group(4)
            if not words or any(w in FUNCTION_WORDS or w in ("bis", "ter", "quater") for w in words):
                continue
            if m.group(5) and m.group(5).strip(" .").casefold() in ("e", "w", "s", "n") and not m.group(5).strip(" .").isupper():
                b = m.end(4)
                s = t[a:b]
            name = "".join(m.group(3).split())
            styled = name[:1].isupper() or m.group(4)[:1].islower()
            if s.endswith(".") and b == m.end(4):
                rest = t[b : b + 2]
                ends = not rest.strip() or (rest[:1].isspace() and (rest[1:2].isupper() or not rest[1:2].isalnum()))
                if rest[:1] in "\r\n" or ends:
                    if not LABEL_WITHOUT_POINT.search(before):
                        b -= 1
                if kind.strip(".").casefold() in ("street", "avenue", "road", "lane", "drive", "court", "boulevard", "square", "terrace", "crescent", "close", "way", "row", "place") and t[b - 1] == ".":
                    b -= 1
        elif form == "de":
            words = [w.casefold() for w in m.group(1).split()]
            styled = m.group(1)[:1].isupper()
            if words[0] in FUNCTION_WORDS and words[0] not in ("am", "im", "an", "auf", "zum", "zur"):
                continue
            if words[0] in ("am", "im", "an", "auf", "zum", "zur") and not GERMAN_PLACE.search(words[-1]):
                continue
        else:
            name = STREET_NAME_HEAD.sub("", m.group(2 if form == "fr" else 1))
            styled = name[:1].isupper() or s.islower()
            if form == "fr" and not styled:
                continue
        cue = bool(BEFORE_ADDRESS.search(before))
        tail = bool(AFTER_ADDRESS.search(t[b : b + 24]))
        if t[b : b + 1].isalnum():
            continue
        nwords = len(s.split())
        votes = (1 if form != "en" or len(m.group(4)) > 2 else 0, 1 if cue else -1, 1 if styled else 0, 1 if nwords >= 2 else 0, 1 if tail else -1)
        out.append(Span("address", a, b, form, votes, (f"form={form}", f"cue={cue}", f"tail={tail}", f"styled={styled}", f"prev={_last_word(before)}")))


def _style(w: str) -> str:
    """U, T or l for upper, title and lower case; apostrophes and hyphens do not matter."""
    if w.isupper() and len(w) > 1:
        return "U"
    return "T" if w[:1].isupper() else "l"


def _parts(token: str) -> list[str]:
    return [p for p in token.casefold().split("-") if p]


def _in(token: str, words: frozenset) -> bool:
    return token.casefold() in words or any(p in words for p in _parts(token))


def _person_span(t: str, a: int, b: int, form: str, given: str, family: str, lex: Lexicon, out: list[Span], cues: set) -> None:
    before, after = t[max(0, a - 32) : a], t[b : b + 16]
    cue, follows = a in cues, bool(AFTER_PERSON.search(after))
    g, f = given.casefold(), family.casefold()
    in_given, in_family = not given or g in lex.given, _in(family, lex.family)
    plain = _in(family, lex.common) or g in lex.common or f in FUNCTION_WORDS  # as if the names were in no gazetteer
    common = _in(family, lex.common) and not in_family or (bool(given) and g in lex.common and not in_given) or f in FUNCTION_WORDS
    known = (1 if g in lex.given else -1) if given else 0
    shape = 1 if _style(family) != "l" and (not given or _style(given) == _style(family) or len(given) == 1) else 0
    said, seen = (1 if cue else 0, 1 if follows else 0), g in lex.given or in_family
    context = (f"form={form}", *_context(t, a, b), f"style={_style(family)}", f"cue={cue}{follows}", f"space={before[-1:].isspace()}")
    votes = (*said, known, 1 if in_family else 0, -1 if common else 1, shape)
    unseen = (*said, 0, 0, -1 if plain else 1, shape), ("unseen", *context, f"common={plain}")
    if seen:
        full = (*context, f"common={common}", f"g={g}", f"e4={f[-4:]}", f"s3={f[:3]}")
        out.append(Span("person", a, b, form, votes, full, unseen))
    else:
        out.append(Span("person", a, b, form, votes, unseen[1], None, unseen[0]))


_WORDS_OR_INITIALS = stdre.compile(rf"(?<![^\W_])(?:{_TOKEN}|{_WORD}\.)")
BEFORE_PERSON = re.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{PERSON_CUE})\s?[\"'`]?$", _F)
#: Words that a cue of a person ends in, before a blank or before other signs; only after one of them, or
#: after two hyphens, is the cue's pattern tried.
CUE_ENDS = frozenset(
    """by as cc ask contact laut según d'après d’après selon frau herr herrn señora señor doctora doctor professor patient patientin met called
    emailed contacted asked told thank regards wishes best спросите à a dr prof mr mrs ms mx mme mlle sra sr""".casefold().split()
) | frozenset(x for r in ROLE.replace("u?r", "r|neighbour").replace("[oa]", "o").split("|") for x in (r, r[:-1] + "a" if r[-2:] in ("ro", "go") else r))
CUE_ENDS_SIGN = frozenset(
    """thanks you regards wishes cheers best sincerely cc from to by author maintainer contact owner name signed-off-by co-authored-by reported-by
    saludos grüße grüßen cordialement 担当 автор уважением assignee user operator reviewer submitter""".casefold().split()
)


#: Fixed: words that come before a name with a comma or a space and are no part of it.
GREETINGS = frozenset(
    """thanks cheers grüße grüßen saludos wishes best regards cordialement greetings sincerely уважением merci gracias danke hi hello dear
    hallo bonjour hola laut según selon as ask patient patientin cc by from frau herr herrn doctora doctor professor prof dr mr mrs ms mx
    mme viele patiente met called emailed contacted asked told thank""".casefold().split()
) | CUE_ENDS - {"a", "à"} | CUE_ENDS_SIGN
_KANA_OR_KANJI = re.compile(_KANJI + r"|[぀-ヿ]")
_HAS_KANJI, _KANJI_RUN = re.compile(_KANJI), re.compile(_KANJI + "{2,7}")
_PARTICLES = frozenset(PARTICLE.split("|"))


def _persons(t: str, lex: Lexicon, out: list[Span], toks: list[tuple[int, int, str]], lowered: list[str]) -> None:
    n = len(toks)
    cues = set()
    for i, (a, _, w) in enumerate(toks):
        end = toks[i - 1][1] if i else 0
        last = lowered[i - 1] if i else ""
        tried = last in CUE_ENDS if t[end : end + 1] == " " else last in CUE_ENDS_SIGN or last in CUE_ENDS
        if (tried or t[max(0, a - 3) : a].rstrip(" ")[-2:] == "--") and BEFORE_PERSON.search(t[max(0, a - 40) : a]):
            cues.add(a)
    given, family = lex.given, lex.family

    def gap(i: int) -> str:
        return t[toks[i][1] : toks[i + 1][0]] if i + 1 < n else "\n"

    def initial(i: int) -> bool:
        return i < n and len(toks[i][2]) == 1 and t[toks[i][1] : toks[i][1] + 1] == "." and toks[i][2].isalpha()

    def family_at(i: int) -> int:
        """Index after a family name (with particles) that begins at token i, or 0."""
        j = i
        while j < n and lowered[j] in _PARTICLES and gap(j) == " " and j - i < 2:
            j += 1
        if j < n and len(toks[j][2]) >= 2 and lowered[j] not in FUNCTION_WORDS:
            return j + 1
        return 0

    # ordinary lower-case words begin no name, unless they are names, come before one, or follow a cue
    for i, (a, b, w) in enumerate(toks):
        cf = lowered[i]
        known = cf in given
        if cf is w and not known and cf not in family and not (i + 1 < n and lowered[i + 1] in given) and len(w) > 1 and a not in cues:
            continue
        if cf in FUNCTION_WORDS and not initial(i) or _KANA_OR_KANJI.match(w):
            continue
        style = _style(w)
        # Given [I.] [particle] Family
        if len(w) >= 2 and gap(i) == " " and (known or style != "l" or a in cues) and cf not in GREETINGS:
            j = i + 1
            if initial(j) and t[toks[j][1] : toks[j][1] + 2] == ". ":
                j += 1
            e = family_at(j)
            if e and (e == j + 1 or gap(j) == " "):
                fam = toks[e - 1][2]
                if (known or style != "l" or a in cues) and (_style(fam) == style or known and (style, _style(fam)) != ("T", "l") or _in(fam, family)):
                    _person_span(t, a, toks[e - 1][1], "gf" if e == j + 1 else "gpf", w, fam, lex, out, cues)
        # I. [I.] [particle] Family
        if initial(i) and t[b : b + 2] == ". ":
            j = i + 1
            if initial(j) and t[toks[j][1] : toks[j][1] + 2] == ". ":
                j += 1
            e = family_at(j)
            house = i and AFTER_HOUSE.search(t[max(0, a - 4) : a])
            if e and not house and (i == 0 or not (lowered[i - 1] in given and t[toks[i - 1][1] : a] == " ")):
                fam = toks[e - 1][2]
                if _style(fam) != "l" or _in(fam, family) or a in cues:
                    _person_span(t, a, toks[e - 1][1], "if", "", fam, lex, out, cues)
        # Family, Given and Family, I.
        if len(w) >= 3 and i + 1 < n and gap(i) == ", " and cf not in GREETINGS and not known:
            start = a
            if i and lowered[i - 1] in _PARTICLES and t[toks[i - 1][1] : a] == " " and (_in(w, family) or toks[i - 1][0] in cues):
                start = toks[i - 1][0]
            g = toks[i + 1][2]
            if initial(i + 1):
                if style != "l" or _in(w, family) or start in cues:
                    _person_span(t, start, toks[i + 1][1] + 1, "f,i", "", w, lex, out, cues)
            elif lowered[i + 1] in given and (style == _style(g) or _in(w, family)):
                _person_span(t, start, toks[i + 1][1], "f,g", g, w, lex, out, cues)
            elif start in cues and style != "l" and style == _style(g) and lowered[i + 1] not in FUNCTION_WORDS:
                _person_span(t, start, toks[i + 1][1], "f,g", g, w, lex, out, cues)
        # Family Given
        if not known and i + 1 < n and gap(i) == " " and lowered[i + 1] in given and _in(w, family):
            _person_span(t, a, toks[i + 1][1], "fg", toks[i + 1][2], w, lex, out, cues)
    if _HAS_KANJI.search(t):
        for m in KANJI_NAME.finditer(t):
            whole = m.group(0)
            core = m.group(1), m.group(2)
            fam, giv = (core if core[0] else (whole[:-2], whole[-2:]))
            _person_span(t, m.start(), m.end(), "kanji", giv, fam, lex, out, cues)
        for m in _KANJI_RUN.finditer(t):
            run = m.group(0)
            if m.start() in cues and 3 <= len(run) <= 6:
                _person_span(t, m.start(), m.end(), "kanji", run[-2:], run[:-2], lex, out, cues)
            for k in range(1, len(run)):
                if run[:k] in family and run[k:] in given:
                    _person_span(t, m.start(), m.end(), "kanji", run[k:], run[:k], lex, out, cues)


def find_spans(t: str, lex: Lexicon) -> list[Span]:
    """All candidates of a text, overlapping ones included."""
    out: list[Span] = []
    toks = [(m.start(), m.end(), m.group()) for m in _WORDS_OR_INITIALS.finditer(t)]
    lowered = [w if w.isascii() and w.islower() else w.casefold() for _, _, w in toks]
    _emails(t, out)
    if DIGITS.search(t):
        _numbers(t, out, frozenset(lowered))
    if ANY_DIGIT.search(t):
        _addresses(t, out)
    _persons(t, lex, out, toks, lowered)
    return out


STRONG_PERSON = re.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:(?:Dr|Prof|Mr|Mrs|Ms|Mme)\. |Frau |Herr |Patient |Thanks, |cc: |Author: |Maintainer: |[Cc]ontact: |Signed-off-by: |Laut |Según |D'après |Demandez à |Saludos, |Viele Grüße, |La doctora |Ask |-- |Автор: |С уважением, |Спросите, )"
    rf"({_TOKEN})(?: {_WORD}\.)? (?:(?:{PARTICLE}) )?({_TOKEN})"
)
STRONG_KANJI = re.compile(rf"(?<!{_KANJI})({_KANJI}{{1,4}})[ 　]({_KANJI}{{1,3}})(?=さん|氏|様|です。よろしく)|(?<=担当[:：]\s?)({_KANJI}{{1,4}})[ 　]({_KANJI}{{1,3}})(?!{_KANJI})")


def name_evidence(t: str) -> tuple[set, set, set]:
    """(given names, family names, all words) that a text gives evidence of, in casefold. Only title
    case counts as evidence of a name."""
    given, family = set(), set()
    for m in STRONG_PERSON.finditer(t):
        g, f = m.group(1), m.group(2)
        if len(g) > 1 and _style(g) == "T" and _style(f) == "T":
            given.add(g.casefold())
            family.update([f.casefold(), *_parts(f)])
    for m in STRONG_KANJI.finditer(t):
        family.add(m.group(1) or m.group(3))
        given.add(m.group(2) or m.group(4))
    return given, family, set(map(str.casefold, TOKENS.findall(t)))


def looked_up(t: str) -> set:
    """Every word of a text that the search looks up in a gazetteer, in casefold."""
    words = {m.group().casefold().rstrip(".") for m in _WORDS_OR_INITIALS.finditer(t)}
    words |= {p for w in words if "-" in w for p in w.split("-")}
    for m in KANJI_NAME.finditer(t):
        words |= {x for x in (*m.groups(), m.group(0)[:-2], m.group(0)[-2:]) if x}
    for m in _KANJI_RUN.finditer(t):
        run = m.group(0)
        words |= {x for k in range(1, len(run)) for x in (run[:k], run[k:])}
    return words
