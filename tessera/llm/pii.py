"""Problem 3: personal information in free text, found and replaced.

One Aho-Corasick pass over the lower-cased text finds the places worth a look (given names, phrases that
introduce a person, street words, labels of identity numbers, at-signs); small patterns are applied there
only. Digit groups, and capitalised first names or initials with a surname, are found by one pattern each
over the text; the latter count by lists of names, by words that are no ordinary ones (a vocabulary of public
tokenizers tells them), by context and by email addresses nearby that spell them. Finds that overlap are settled in favour of
email, then identity number, phone, address, name.

``redact`` replaces each find either by a placeholder of its type or by a surrogate: a replacement keyed
by a secret and by the entity's normal form alone, so one person or number gets the same surrogate
everywhere (coreference), of the same type and layout: digits are enciphered in place by a keyed
permutation (so distinct numbers stay distinct), names keep gender, case, script, particles and order, street
addresses their street words and the layout of their numbers, and emails their spelling and a reserved domain.
Entities that would share a surrogate are re-keyed before any is written; ``surrogate_collisions`` checks that
distinct entities got distinct surrogates.

Defined results: null and empty texts have no finds and come out unchanged; of rows with one record id
all distinct texts are read and equal finds come out once; positions count code points from 0 in the
text as stored; texts of any length are read whole; columns beside the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import people
from tessera.llm.spans import Spans, settled
from tessera.runtime import materialise

GIVEN = {**dict.fromkeys([w for w in people.FEMALE if w not in people.DOUBTFUL], "f"), **dict.fromkeys([w for w in people.MALE if w not in people.DOUBTFUL], "m")}
SURNAME_END = re.compile(people.SURNAME_END, re.I)
STREETS = "street|st|lane|drive|way|road|rd|blvd|boulevard|avenue|ave|court|ct|terrace|place|square|close|crescent|row"
EURO_STREETS = ("rue ", "chemin ", "impasse ", "avenue ", "boulevard ", "place ", "quai ", "allée ", "calle ", "c/ ", "plaza ", "avenida ", "paseo ", "am ", "an der ", "straße ", "strasse ", "weg ", "gasse ", "platz ", "allee ")
LABELS = ("national insurance", "nino", "ni number", "nif", "dni", "nie", "passport", "passeport", "pasaporte", "reisepass", "personalausweis", "qq")

_W = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_PART = r"(?:(?i:de\s+la|de\s+los|van\s+der|van\s+den|de|del|van|von|der|di|da|la|le|bin|al|ter|zu)\s+)?"
_FIRST_LAST = rf"(?:(?P<g>{_W})|[^\W\d_]\.)\s+(?:[^\W\d_]\.\s+)?{_PART}(?P<s>{_W})"
_LAST_FIRST = rf"{_PART}(?P<s2>{_W})\s?,\s+(?:(?P<g2>{_W})|[^\W\d_]\.)(?:\s+[^\W\d_]\.)?"
NAME_AT = re.compile(rf"(?:{_FIRST_LAST}|{_LAST_FIRST})(?![\w@])")
_CAP = r"[^\W\d_a-z][^\W\d_]*(?:['’\-][^\W\d_]+)*"  # an upper-case letter first; other scripts' small letters are sorted out by title()
SHAPE = re.compile(rf"(?<![\w@/'’\-])(?<![\w]\.)(?P<i>(?:[^\W\d_a-z]\.[ \xa0]?){{1,3}}|{_CAP}[ \xa0]+(?:[^\W\d_a-z]\.[ \xa0]+)?)(?:[ \xa0\n]*)(?P<p>{_PART})(?P<s>{_CAP})(?![\w@(]|\.\w|[/-]\w)")
DOES = re.compile(rf"['’]s\b|,?\s+(?P<v>{people.DOES})\b")
CUES = re.compile(people.CUES, re.I)
SOFT = re.compile(people.SOFT, re.I)
ARTICLE = re.compile(people.ARTICLE, re.I)
NOUN_END = re.compile(people.NOUN_END)
#: Vocabularies of public tokenizers (lines of base64 and rank), a parameter: what they hold in small letters is an ordinary word.
LEXICONS = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
NAME_END = re.compile(rf"(?<![\w.@])(?:{_FIRST_LAST}|{_LAST_FIRST})$")
EMAIL_AT = re.compile(r"(?P<l>[^\W_][\w.+\-]*|_[\w.+\-]+)(?:@|\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+(?=[\w\-]+\s+dot\s))(?P<d>[\w\-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)[^\W_][\w\-]*)+)", re.I)
FILE_END = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|py|go|rs|ts|js|java|css|html?|json|ya?ml|md|txt)$", re.I)
PHONE = re.compile(
    r"(?<![\w.+\-/#])(?:"
    r"(?:\+|00)[1-9]\d{0,2}[\s.\-]?(?:\(0\)\s?)?(?:\(?\d{1,4}\)?[\s.\-/]?){2,6}\d"
    r"|\(\d{3}\)\s?\d{3}[\s.\-]\d{4}|[2-9]\d{2}[\-.\s][2-9]\d{2}[\-.]\d{4}"
    r"|0\d(?:[.\s]\d{2}){4}|0\d{2}\s\d{4}\s\d{4}|0\d{2,4}[/\-]\s?\d{5,9}|0\d{3,4}\s\d{6}"
    r")(?![\w]|[\-.]\d)"
)
NUMBER = re.compile(r"(?<![\w.+\-/#])\d{2,3}[\s\-]?\d{2,3}[\s\-]?\d{3,4}(?:[\s\-]?\d{3})?(?![\w]|[\-.]\d)")
SSN_DASHED = re.compile(r"\d{3}-\d{2}-\d{4}$")
SSN_OTHER = re.compile(r"\d{3}[\s\-]?\d{2}[\s\-]?\d{4}$")
TAX = re.compile(r"\d{2}[\s\-]?\d{3}[\s\-]?\d{3}[\s\-]?\d{3}$")
SSN_LABEL = re.compile(r"(?:\bssn|social\s+security|soc\.?\s*sec)[\w\s.:#]{0,16}$", re.I)
TAX_LABEL = re.compile(r"(?:steuer-?\s?id|steuernummer|idnr|tax\s+id|tax\s+no|\btin|tax\s+number)[\w\s.:#]{0,10}$", re.I)
NINO = re.compile(r"(?<!\w)[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]?(?!\w)")
LABELLED = re.compile(r"(?:\b(?:nif|dni|nie)\b[\s:#.]{0,3}(?:n[oº°.]{1,2}\s?)?(?P<a>[XYZ]?\d{7,8}-?[A-Z])|(?:passport|passeport|pasaporte|reisepass|personalausweis)[\s:#.]{1,3}(?:(?:no|nr|number|n[º°])\.?[\s:#]{0,2})?(?P<b>[A-Z]{1,2}\d{6,9}|\d{9}))(?!\w)", re.I)
ENGLISH_ADDRESS = re.compile(
    rf"(?<![\w.,\-])\d{{1,5}}[A-Za-z]?\s+(?:[^\W\d_][\w'’\-]*\s+){{1,3}}(?:{STREETS})\b\.?(?=\s*(?:,|$|\n|\r|[A-Z][a-z]+\s+[A-Z]{{1,2}}\d|[.;:)]))"
    r"(?:,\s*(?:apt|unit|suite|flat|no)\.?\s*\w+)?(?:(?:,\s*|\s+)[^\W\d_][^\W\d_'’\-]*(?:[ \-][A-Z][^\W\d_]+)?(?:(?:,\s*|\s+)(?:[A-Z]{2}\s+\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]?\s+\d[A-Z]{2}))?)?", re.I,
)
FRENCH_ADDRESS = re.compile(r"(?<![\w.\-])\d{1,4}(?:\s+(?:bis|ter))?,?\s+(?:rue|chemin|impasse|avenue|boulevard|place|quai|allée)\s+[^\d,;\n]{2,60}?(?:\s*\n[^\d,;\n]{2,40}?)?(?:,\s*\d{5}\s+[^\W\d_][\w'’\-]*|(?=[.,;\n]))", re.I)
SPANISH_ADDRESS = re.compile(r"(?<!\w)(?:calle|c/|plaza|avenida|paseo)\s+[^\d,;]{2,60}?,?\s+\d{1,4}(?:,\s*\d{1,2}\s?º\s?\w)?(?:,\s*(?:\d{5}\s+)?[^\W\d_][\w'’\-]*)?", re.I)
GERMAN_ADDRESS = re.compile(r"(?<!\w)(?:(?:Am|An der|Im|Zum|Zur)\s+)?[^\W\d_][\w\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|\btor)?\s+\d{1,4}\s?[a-z]?,\s*\d{5}\s+[^\W\d_][\w\-]*")


def ordinary_words(paths: tuple[str, ...] = LEXICONS) -> frozenset[str]:
    """Words of at least four letters that the vocabularies hold in small letters with a blank before them; none where there is no file."""
    out = set()
    for path in paths:
        if os.path.exists(path):
            with open(path, "rb") as lines:
                for line in lines:
                    token = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
                    if len(token) > 4 and token[0] == " " and token[1:].isalpha() and token.islower():
                        out.add(token[1:])
    return frozenset(out)


def _triggers() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for w in GIVEN:
        kinds.setdefault(w, set()).add("given")
    for w in people.BEFORE:
        kinds.setdefault(w, set()).add("before")
    for w in people.FIELDS:
        kinds.setdefault(w, set()).add("field")
    for w in people.AFTER:
        kinds.setdefault(w, set()).add("after")
    for w in STREETS.split("|"):
        kinds.setdefault(" " + w, set()).add("street")
    for w in EURO_STREETS:
        kinds.setdefault(w, set()).add("euro")
    for w in LABELS:
        kinds.setdefault(w, set()).add("label")
    for w in ("@", "(at)", "[at]", "{at}", "( at )", "[ at ]", " dot "):
        kinds.setdefault(w, set()).add("email")
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(k)))
    a.make_automaton()
    return a


FIELD_SEP = re.compile(people.FIELD_SEP)
PAIR = re.compile(rf"(?<![\w.@+\-])(?:(?P<f>[^\W\d_]+(?:['’\-][^\W\d_]+)*)\.?[ \xa0]+(?:[^\W\d_]\.[ \xa0]+)?(?P<s>{_W})|(?P<t>{_W}),[ \xa0]+(?P<g>[^\W\d_]+)\.?)(?![\w@])")


def _folded(word: str) -> str:
    """Small letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("ß", "ss")


_SPACES = dict.fromkeys(map(ord, "\t\n\r\x0b\x0c\xa0\u2002\u2003\u2009\u202f\u3000"), " ")
MOST_CLASHES = 50_000
TYPES = ("email", "id_number", "phone", "address", "name")


class Detector:
    """Finds (start, end, type) in a text."""

    def __init__(self, lexicon: frozenset[str] | None = None):
        self.triggers = _triggers()
        self.lexicon = ordinary_words() if lexicon is None else lexicon

    def _ordinary(self, word: str) -> bool:
        low = word.lower()
        return low in people.WORDS or low in self.lexicon or low in _STREET_WORDS or NOUN_END.search(low) is not None

    def finds(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        low = low.translate(_SPACES)  # phrases also match across line ends and odd blanks
        out: list[tuple[int, int, str]] = []
        names: list[tuple[int, str]] = []
        for end, (size, kinds) in self.triggers.iter(low):
            at = end - size + 1
            for kind in kinds:
                if kind == "email":
                    self._email(text, at, end + 1, out)
                elif kind in ("street", "euro"):
                    self._address(text, low, at, end + 1, kind, out)
                elif kind == "field":
                    if (at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_")) and (m := FIELD_SEP.match(text, end + 1)):
                        names.append((m.end(), "field"))
                elif kind == "label":
                    if at == 0 or not low[at - 1].isalnum():
                        self._label(text, at, out)
                else:
                    names.append((at if kind != "before" else end + 1, kind if kind != "before" or not at or not low[at - 1].isalnum() and not (low[at:end] == "ms." and low[max(0, at - 2) : at - 1].isdigit()) else ""))
        if any(map(str.isdigit, low)):
            self._numbers(text, out)
        contacts = [f for f in out if f[2] in ("email", "phone")]
        for a, b, kind in contacts:
            if kind == "email":
                self._told_by_email(text, a, b, out)
        for at, kind in names:
            self._name(text, low, at, kind, out)
        self._shaped(text, out)
        for a, _, _ in contacts:  # a name that stands before a phone number or an address in a record
            m = re.search(r"[,;|<(\t]\s*\"?$", text[max(0, a - 4) : a])
            if m:
                self._name_before(text, max(0, a - 4) + m.start(), out, strict=True)
        return _settled(out)

    def _email(self, text: str, at: int, end: int, out: list) -> None:
        lo = max(0, at - 330)  # an address has at most 64 characters before its sign and 255 behind
        for m in EMAIL_AT.finditer(text, lo, min(len(text), end + 330)):
            if m.start() <= at < m.end():
                start, stop = m.span()
                local, domain = m["l"], m["d"]
                if local.lower().startswith("mailto"):
                    continue
                token = re.search(r"[^\s\"'<>|,;]*$", text[max(0, start - 80) : start])[0]
                after = text[stop : stop + 2]
                if "://" in token or (after[:1] == ":" and after[1:2].strip() and not after[1:2].isdigit() and "@" in m[0]):
                    return  # credentials in an address of a service, or a repository
                if FILE_END.search(domain) or re.match(r"\d+x\b", domain) or local.lower() in ("git", "hg", "svn"):
                    return
                if token.endswith("@") or (start and text[start - 1] in ":/" and not token.lower().endswith("mailto:") and "@" in m[0] and "/" in token):
                    return
                out.append((start, stop, "email"))
                return

    def _told_by_email(self, text: str, a: int, b: int, out: list) -> None:
        """Names near an address whose local part spells them (first.last, last_first, flast)."""
        local = _folded(re.split(r"@|\s|\(|\[|\{", text[a:b], maxsplit=1)[0])
        parts = [x for x in re.split(r"[^a-z]+", local) if len(x) > 1]
        if not parts:
            return
        lo = max(0, a - 200)
        for m in PAIR.finditer(text, lo, min(len(text), b + 200)):
            first, last = (m["f"], m["s"]) if m["f"] else (m["g"], m["t"])
            x, y = _folded(first), _folded(last)
            if len(y) > 2 and len(x) > 0 and (x in parts and y in parts or any(q in (x[0] + y, x + y, y + x, y + x[0]) for q in parts)) and not (a <= m.start() < b):
                out.append((m.start(), m.end(), "name"))

    def _label(self, text: str, at: int, out: list) -> None:
        m = LABELLED.match(text, at)
        if m:
            g = "a" if m["a"] else "b"
            out.append((m.start(g), m.end(g), "id_number"))
            return
        m = NINO.search(text, at, at + 40)
        if m and not re.search(r"\d", text[at : m.start()]):
            digits = sum(c.isdigit() for c in m[0])
            if digits == 6 and (m[0][:2] == "QQ" or m.start() > at) and (m[0].rstrip()[-1].isalpha() or m.start() > at):
                out.append((m.start(), m.end(), "id_number"))

    def _numbers(self, text: str, out: list) -> None:
        for m in PHONE.finditer(text):
            value = _trimmed(m[0])
            if 9 <= sum(map(str.isdigit, value)) <= 15 and "\n\n" not in value:
                out.append((m.start(), m.start() + len(value), "phone"))
        for m in NUMBER.finditer(text):
            pre = text[max(0, m.start() - 40) : m.start()]
            if SSN_DASHED.match(m[0]) or SSN_OTHER.match(m[0]) and SSN_LABEL.search(pre) or TAX.match(m[0]) and TAX_LABEL.search(pre):
                out.append((m.start(), m.end(), "id_number"))

    def _address(self, text: str, low: str, at: int, end: int, kind: str, out: list) -> None:
        lo, hi = max(0, at - 160), min(len(text), end + 240)
        if kind == "street":
            if end < len(low) and low[end].isalnum():
                return
            for m in ENGLISH_ADDRESS.finditer(text, lo, hi):
                if m.start() < at < m.end():
                    words = re.findall(r"[^\W\d_]+", text[m.start() : end])
                    if all(w[:1].isupper() for w in words) or all(w.islower() for w in words) and re.search(r"\d{5}|\d[a-z]{2}\b", m[0][end - m.start() :], re.I):
                        out.append((m.start(), m.end(), "address"))
            return
        word = low[at:end].strip()
        form = FRENCH_ADDRESS if word in ("rue", "chemin", "impasse", "avenue", "boulevard", "place", "quai", "allée") else SPANISH_ADDRESS if word in ("calle", "c/", "plaza", "avenida", "paseo") else GERMAN_ADDRESS
        for m in form.finditer(text, lo, hi):
            if m.start() <= at < m.end():
                if form is GERMAN_ADDRESS and not text[m.start()].isupper():
                    continue
                out.append((m.start(), m.end(), "address"))

    def _name(self, text: str, low: str, at: int, kind: str, out: list) -> None:
        if kind in ("before", "field"):
            m = NAME_AT.match(text, at)
            if m and kind == "field" and ("\n" in m[0] and "," not in m[0] or not m[0][0].isupper() or m[0].isupper() and text[at - 1 : at] not in ("'", '"')):
                m = None
            if m and self._is_name(m, hinted=True):
                out.append((m.start(), m.end(), "name"))
        elif not kind:
            return
        elif kind == "after":
            self._name_before(text, at, out, strict=False)
        else:
            if at and (low[at - 1].isalnum() or low[at - 1] in "_@.+"):
                return
            m = NAME_AT.match(text, at)
            if m and m["g"] and m["g"].lower() in GIVEN and self._is_name(m, hinted=False):
                out.append((m.start(), m.end(), "name"))
                return
            lead = re.search(rf"(?<![\w.@\-]){_PART}({_W})\s?,\s+$", text[max(0, at - 50) : at])
            word = re.match(_W, text[at:])
            if lead and word and word[0].lower() in GIVEN:
                m = NAME_AT.match(text, max(0, at - 50) + lead.start())
                if m and m["s2"] and self._is_name(m, hinted=False):
                    out.append((m.start(), m.end(), "name"))

    def _name_before(self, text: str, at: int, out: list, strict: bool) -> None:
        lo = max(0, at - 160)
        part = text[lo:at].rstrip()
        for cut in (part.rfind("\n"), -1):
            piece = part[cut + 1 :]
            m = NAME_END.search(piece)
            while m and not self._is_name(m, hinted=True):
                m = NAME_END.search(piece, m.start() + 1)
            if m:
                out.append((lo + cut + 1 + m.start(), lo + cut + 1 + m.end(), "name"))
                return

    def _shaped(self, text: str, out: list) -> None:
        """Names of any capitalised first name or initials with a surname: what is in no list counts by its context."""
        taken, named = Spans(), set()
        for a, b, t in out:
            if t == "name":
                taken.add(a, b)
                named.add(" ".join(text[a:b].lower().split()))
        at, left = 0, []
        while m := SHAPE.search(text, at):
            at = m.end("i")
            if not taken.free(m.start(), m.end()):
                continue
            first, last = m["i"].split()[0], m["s"]
            if not _titled(last) or last.lower() in people.WORDS or last.lower() in _STREET_WORDS or len(last) < 2:
                continue
            initials = first.endswith(".")
            if not first[0].isupper() or not initials and (not _titled(first) or len(first) < 2 or first.lower() in people.WORDS):
                continue
            end = m.end()
            if last[-2:] in ("'s", "’s"):
                last, end = last[:-2], end - 2
            listed, surname = not initials and first.lower() in people.DOUBTFUL, last.lower() in people.SURNAMES or bool(SURNAME_END.search(last)) and len(last) > 4
            after = DOES.match(text, end)
            does = 0 if not after else 2 if not after["v"] or after["v"] in people.STRONG else 1
            before = text[max(0, m.start() - 40) : m.start()]
            cue = 2 if CUES.search(before) else 1 if SOFT.search(before) else 0
            if initials and "\n" in text[m.end("i") - 1 : m.start("s")]:
                continue
            if initials and re.search(r"[^\W\d_]\s+$", before[-3:]) and cue < 2 and (does < 2 and not surname or last.lower() in people.WORDS):
                continue  # the end of a sentence: option B. Then
            # words that are no ordinary ones speak for a name, ordinary ones and an article against it
            odd = sum(self._ordinary(w) for w in ([last] if initials else [first, last]))
            shape = 1 - odd if not odd or not surname else 1 - odd - (not initials and self._ordinary(first))
            if ARTICLE.search(before):
                shape -= 2
            if 2 * surname + listed + min(does + cue, 3) + shape >= 2 + (odd > 1):
                out.append((m.start(), end, "name"))
                taken.add(m.start(), end)
                named.add(" ".join(text[m.start() : end].lower().split()))
                at = end
            else:
                left.append((m.start(), end))
        if left and named:  # whoever is named elsewhere in the text
            out.extend((a, b, "name") for a, b in left if " ".join(text[a:b].lower().split()) in named)

    def _is_name(self, m: re.Match, hinted: bool) -> bool:
        given, last = m["g"] or m["g2"], m["s"] or m["s2"]
        known = bool(given) and given.lower() in GIVEN
        if len(last) < 3 or m["s2"] and given and not known and not (hinted and given[:1].isupper() and last[:1].isupper() and not self._ordinary(last)):
            return False
        shaped = bool(SURNAME_END.search(last))
        title = last[:1].isupper() and (given is None or given[:1].isupper())
        if known and not hinted and (last.lower() in people.WORDS or last.lower() in _STREET_WORDS):
            return False
        if known:
            lower = hinted and given.islower() and last.islower() and len(last) > 3 and not self._ordinary(last)
            return shaped or lower or title and (given[1:].isupper() == last[1:].isupper() or not given.isupper())
        if given is None:  # an initial
            return hinted and title and (shaped or len(last) > 3) and not self._ordinary(last) or shaped and title
        if not hinted or self._ordinary(given) or self._ordinary(last) and not shaped:
            return False
        return title and len(given) > 1 or given.islower() and last.islower() and len(given) > 2 and len(last) > 3 and shaped


def _trimmed(number: str) -> str:
    """An international number without the digit groups that its country code has no room for."""
    plain = re.sub(r"^00", "+", number)
    most = next((n for code, n in (("+44", 12), ("+33", 11), ("+34", 11), ("+1", 11), ("+49", 14)) if plain.startswith(code)), 15)
    if not plain.startswith("+"):
        return number
    most += 2 * number.startswith("00") + ("(0)" in number and most < 14)
    while sum(map(str.isdigit, number)) > most and re.search(r"[\s.\-/]\d+$", number):
        number = re.sub(r"[\s.\-/]\d+$", "", number)
    return number


def _titled(word: str) -> bool:
    """Capitalised, not all capitals: Huber, O'Neill, McAdam, Żak, Иванов."""
    return word[0].isupper() and (word[1:2].islower() or word[1:2] in "'’" and len(word) > 3) and not any(c.isdigit() for c in word)


_STREET_WORDS = set(STREETS.split("|")) | {w.strip() for w in EURO_STREETS}
_NOT_LAST = set("the and for with from this that these those your our their his her every each you team support group dataset street lane road monday tuesday wednesday thursday friday saturday sunday".split())


def _settled(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return settled(found, lambda f: (TYPES.index(f[2]), f[0], -f[1]))


def _pools() -> dict[str, dict[str, list[str]]]:
    """Given names to give out, by script and gender."""
    out = {"latin": {"f": [], "m": []}, "cyrillic": {"f": [], "m": []}}
    for names, gender in ((people.FEMALE, "f"), (people.MALE, "m")):
        for w in sorted(set(names) - people.DOUBTFUL):
            out["cyrillic" if "\u0400" <= w[0] <= "\u04ff" else "latin"][gender].append(w.title())
    return out


_KEPT = re.compile(r"(?i)(?:de|del|la|le|les|los|las|du|des|der|die|den|van|von|zu|al|bin|ter|bis|am|an|im|zum|zur|da|di|apt|unit|suite|flat|no|" + STREETS + "|" + "|".join(w.strip() for w in EURO_STREETS) + r")")
_STREET_TAIL = re.compile(r"(?:straße|strasse|str|weg|gasse|platz|allee|ring|ufer|tor)$", re.I)


class Surrogates:
    """Keyed replacements in the layout of what they replace: case, order, particles, initials, separators, the number of digits
    and the script (Latin, Cyrillic, Greek) stay, gender too where the given name tells it. Equal entities get equal ones, distinct
    digits distinct ones; ``salts`` ((kind, normal form) -> number) re-keys entities that would share one, and ``syllables`` is
    the length of invented words, which bounds how many do."""

    SYLLABLES = {
        "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
        "cyrillic": [c + v for c in "бвгдзклмнпрстф" for v in "аеиоу"],
        "greek": [c + v for c in "βγδζκλμνπρστφχ" for v in "αειοη"],
    }
    GIVEN_OUT = _pools()

    def __init__(self, key: bytes, salts: dict[tuple[str, str], int] | None = None, syllables: int = 5):
        if not key:
            raise ValueError("surrogates need a key")
        self.key, self.salts, self.syllables = key, salts or {}, syllables

    def _stream(self, kind: str, value: str) -> int:
        return int.from_bytes(hmac.new(self.key, f"{kind}\0{value}".encode("utf-8", "replace"), hashlib.sha256).digest(), "big")

    @staticmethod
    def normal(kind: str, value: str) -> str:
        """A form whose own form is itself, so that entities can be named by it."""
        while (form := Surrogates._form(kind, value)) != value:
            value = form
        return form

    @staticmethod
    def _form(kind: str, value: str) -> str:
        low = re.sub(r"\s+", " ", value.lower()).strip()
        if kind == "phone":
            return re.sub(r"^00", "+", re.sub(r"\(0\)|[^\d+]", "", low))
        if kind == "id_number":
            return re.sub(r"[^\da-z]", "", low)
        if kind == "email":
            return re.sub(r"\s?[\[({]?\s?\bdot\b\s?[\])}]?\s?", ".", re.sub(r"\s?[\[({]\s?at\s?[\])}]\s?", "@", low))
        if kind == "name" and ", " in low:
            low = " ".join(reversed(low.split(", ", 1)))
        return low

    def _digits(self, kind: str, normal: str, value: str, keep: int = 0) -> str:
        """Digits enciphered by a keyed Feistel network over their whole string: a permutation for each layout."""
        digits = "".join(c for c in value if c.isdigit())
        head, body = digits[:keep], digits[keep:]
        if len(body) < 2:
            return value
        h = len(body) // 2
        a, b, la, lb = int(body[:h]), int(body[h:]), h, len(body) - h
        for r in range(6):
            a, b, la, lb = b, (a + self._stream(f"{kind}{r}{la}{lb}", str(b))) % 10**la, lb, la
        it = iter(head + f"{a:0{la}d}{b:0{lb}d}")
        return "".join(next(it) if c.isdigit() else c for c in value)

    def _word(self, n: int, like: str) -> str:
        """An invented word in the script and case of another."""
        kinds = self.SYLLABLES[_script(like)]
        out = ""
        for _ in range(self.syllables):
            n, k = divmod(n, len(kinds))
            out += kinds[k]
        return _cased(out, like)

    def of(self, kind: str, value: str) -> str:
        normal = self.normal(kind, value)
        salt = self.salts.get((kind, normal))
        seed = f"{normal}\0{salt}" if salt else normal
        part = lambda i: self._stream(kind, f"{seed}\0{i}")
        if kind == "phone":
            keep = len(re.match(r"(?:\+|00)?(?:1|33|44|49|34)?", re.sub(r"\(0\)|[^\d+]", "", value))[0].lstrip("+")) if value[:1] == "+" or value[:2] == "00" else 0
            return self._digits(kind, normal, value.replace("(0)", "\ue000"), keep).replace("\ue000", "(0)")
        if kind == "id_number":
            letters = iter(range(len(value)))
            return re.sub(r"[A-Za-z]", lambda m: _cased(chr(97 + part(next(letters)) % 26), m[0]), self._digits(kind, normal, value))
        if kind == "email":
            m = EMAIL_AT.fullmatch(value)
            local, domain = (m["l"], m["d"]) if m else (value, "")
            dot = re.findall(r"\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+", domain, re.I)
            at = value[len(local) : len(value) - len(domain)] if m else "@"
            return self._word(part(0), local) + at + self._word(part(1), domain or local)[:6] + (dot[-1] if dot else ".") + _cased("invalid", domain or local)
        if kind == "address":
            return self._address(value, part)
        return self._name(value, part)

    def _address(self, value: str, part) -> str:
        at = iter(range(len(value)))

        def swap(m: re.Match) -> str:
            w, n = m[0], part(next(at))
            if w.isdigit():
                return str(n % (9 * 10 ** (len(w) - 1)) + 10 ** (len(w) - 1)) if w[0] != "0" else f"{n % 10 ** len(w):0{len(w)}d}"
            if _KEPT.fullmatch(w):
                return w
            if len(w) < 3:  # states, the letters of postal codes and house numbers
                return "".join(_cased(chr(97 + (n >> 8 * i) % 26), c) for i, c in enumerate(w))
            tail = _STREET_TAIL.search(w)
            return _cased(self._word(n, w).lower() + tail[0].lower(), w) if tail and tail.start() else self._word(n, w)

        return re.sub(r"\d+|[^\W\d_]+", swap, value)

    def _name(self, value: str, part) -> str:
        """Given names first, or last behind a comma; parts joined by a hyphen are replaced one by one."""
        words_ = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", value)]
        real = [(a, b) for a, b in words_ if not _PARTICLE.fullmatch(value[a:b])]
        comma = value.find(",")
        last = [w for w in real if (w[1] <= comma if comma >= 0 else w == real[-1] or value[w[1] : w[1] + 1] in ("-", "'", "’") and w[1] + 1 == real[-1][0])]
        given = [w for w in real if w not in last]
        known = next((g for a, b in given if (g := GIVEN.get(value[a:b].lower()))), None)
        out, end = [], 0
        for a, b in words_:
            w = value[a:b]
            if (a, b) in last:
                new = self._word(part(last.index((a, b))), w)
            elif (a, b) in given:
                i = given.index((a, b))
                n = part(100 + i)
                pools = self.GIVEN_OUT.get(_script(w))
                new = _cased(chr((0x430 if _script(w) == "cyrillic" else 0x3B1 if _script(w) == "greek" else 97) + n % (17 if _script(w) == "greek" else 26)), w) if b - a == 1 else _cased((pool := pools[known or "fm"[part(99) & 1]])[n % len(pool)], w) if pools else self._word(n, w)
            else:
                new = w
            out += [value[end:a], new]
            end = b
        return "".join(out) + value[end:]


_PARTICLE = re.compile(r"(?i)de|la|los|van|der|den|del|von|di|da|le|bin|al|ter|zu")


def _script(word: str) -> str:
    c = next((c for c in word if c.isalpha()), "a")
    return "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word.lower()


def _shared_words(df: DataFrame, paths: tuple[str, ...]):
    """The ordinary words, read on the driver (some 25,000) and sent to the workers once."""
    return df.sparkSession.sparkContext.broadcast(ordinary_words(paths))


def find_pii(rows: DataFrame, lexicons: tuple[str, ...] = LEXICONS) -> DataFrame:
    """(source_table, record_id, pii_type, start_pos, end_pos, entity) of rows (source_table, record_id, body), each find once."""
    shared = _shared_words(rows, lexicons)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector(shared.value)
        for batch in batches:
            out = [
                (src, rec, t, a, b, Surrogates.normal(t, body[a:b]))
                for src, rec, body in zip(batch["source_table"], batch["record_id"], batch["body"])
                for a, b, t in d.finds(body)
            ]
            yield pd.DataFrame(out, columns=["source_table", "record_id", "pii_type", "start_pos", "end_pos", "entity"])

    found = rows.where(F.length("body") >= 5).mapInPandas(run, "source_table string, record_id string, pii_type string, start_pos long, end_pos long, entity string")
    return found.distinct()


def resolve_salts(entities: DataFrame, key: str) -> tuple[dict[tuple[str, str], int], int]:
    """(salts, syllables) by which all distinct entities (pii_type, entity) get distinct surrogates: of those that share one, the first keeps it.

    Only entities that share a surrogate come to the driver. The length of invented words follows the number of entities, so that
    fewer than ``MOST_CLASHES`` are expected to, however many there are.
    """
    each = entities.select("pii_type", "entity").distinct()
    n, syllables = each.count(), 5
    while n * n / (2 * len(Surrogates.SYLLABLES["latin"]) ** syllables) > MOST_CLASHES:
        syllables += 1
    salts: dict[tuple[str, str], int] = {}
    last = None
    while True:
        clash = _surrogates(each, key, salts, syllables)
        shared = clash.groupBy("pii_type", "surrogate").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        rows = clash.join(shared, ["pii_type", "surrogate"]).collect()
        groups: dict[tuple[str, str], list[str]] = {}
        for r in rows:
            groups.setdefault((r["pii_type"], r["surrogate"]), []).append(r["entity"])
        if not groups or groups == last:  # enciphered numbers take no salt
            return salts, syllables
        last = groups
        for (kind, _), same in groups.items():
            for i, e in enumerate(sorted(same, key=lambda e: (salts.get((kind, e), 0), e))[1:], 1):
                salts[kind, e] = salts.get((kind, e), 0) + i


def redact(rows: DataFrame, key: str, lexicons: tuple[str, ...] = LEXICONS) -> DataFrame:
    """(source_table, record_id, redacted, surrogate_text, finds): every row with its finds replaced by placeholders, and by surrogates
    that are distinct for distinct entities of all the rows. The texts are read once; their finds are kept in a written table.
    The key is a secret of the caller: with it, and only with it, equal entities of other tables get equal surrogates."""
    shared = _shared_words(rows, lexicons)

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector(shared.value)
        for batch in batches:
            lists = [[{"pii_type": t, "start_pos": lo, "end_pos": hi, "entity": Surrogates.normal(t, body[lo:hi])} for lo, hi, t in d.finds(body)] if body else [] for body in batch["body"]]
            yield pd.DataFrame({"source_table": batch["source_table"], "record_id": batch["record_id"], "body": batch["body"], "found": lists})

    found = materialise(
        rows.mapInPandas(detect, "source_table string, record_id string, body string, found array<struct<pii_type:string,start_pos:bigint,end_pos:bigint,entity:string>>"),
        label="personal",
    )
    salts, syllables = resolve_salts(found.select(F.explode("found").alias("f")).select("f.pii_type", "f.entity"), key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Surrogates(key.encode(), salts, syllables)
        for batch in batches:
            placed, swapped, lists = [], [], []
            for body, finds in zip(batch["body"], batch["found"]):
                a, b, at = [], [], 0
                for f in finds:
                    lo, hi, t = f["start_pos"], f["end_pos"], f["pii_type"]
                    a += [body[at:lo], f"[{t.upper()}]"]
                    b += [body[at:lo], s.of(t, body[lo:hi])]
                    at = hi
                placed.append("".join(a) + body[at:] if body is not None else None)
                swapped.append("".join(b) + body[at:] if body is not None else None)
                lists.append([{"pii_type": f["pii_type"], "start_pos": f["start_pos"], "end_pos": f["end_pos"]} for f in finds])
            yield pd.DataFrame({"source_table": batch["source_table"], "record_id": batch["record_id"], "redacted": placed, "surrogate_text": swapped, "finds": lists})

    return found.mapInPandas(run, "source_table string, record_id string, redacted string, surrogate_text string, finds array<struct<pii_type:string,start_pos:bigint,end_pos:bigint>>")


def _surrogates(entities: DataFrame, key: str, salts: dict[tuple[str, str], int], syllables: int = 5) -> DataFrame:
    @F.pandas_udf("string")
    def swap(kind: pd.Series, value: pd.Series) -> pd.Series:
        s = Surrogates(key.encode(), salts, syllables)
        return pd.Series([s.of(k, v).lower() for k, v in zip(kind, value)])

    return entities.withColumn("surrogate", swap("pii_type", "entity"))


def surrogate_collisions(found: DataFrame, key: str, salts: dict[tuple[str, str], int] | None = None, syllables: int = 5) -> DataFrame:
    """(pii_type, surrogate, entities): surrogates that distinct entities share; the check that redaction keeps entities apart."""
    each = _surrogates(found.select("pii_type", "entity").distinct(), key, salts or {}, syllables)
    return each.groupBy("pii_type", "surrogate").agg(F.count("*").alias("entities")).where(F.col("entities") > 1)
