"""Problem 6: credentials inside code and configuration, found and masked.

One Aho-Corasick pass finds key names, token prefixes and armour lines; the assignment (or header,
URL, XML element, block attribute, command option, comment) around each is parsed and its value
judged. Literals that look encoded (base64 on one line or wrapped over several, hex, percent, backslash
escapes) are decoded; decoded text is scanned again, as deep as there are layers (each is shorter than the
one around it), and decoded bytes are read by the grammar of key containers (DER: PKCS#1, PKCS#8, SEC1; the
OpenSSH header). A find inside a layer is reported, and masked, as the whole literal in the text, so that
the code around it stays intact.

Masking keeps quotes, line structure and length: letters and digits of a value become ``*``.

Defined results: null and empty texts have no finds and come out unchanged; of rows with one id all
distinct texts are read and equal finds come out once; a value that is a placeholder, a reference
to the environment or a vault, a name, a hash or a public key is no find; positions count code
points from 0 in the text as stored; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
from collections.abc import Iterator
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import settled

#: What the name of a secret ends in; the whole name decides how its value is judged (``named``).
STEMS = ("password", "passwd", "passphrase", "passcode", "secret", "token", "credential", "credentials", "bearer", "authorization", "pwd", "pass", "pw", "key", "sig", "signature", "auth")
#: Ends of names (without punctuation) whose value is a secret whatever it looks like, short of a placeholder.
SURE = tuple("password passwd passphrase passcode secret credential credentials bearer pwd apikey accesskey secretkey privatekey signingkey encryptionkey authkey accountkey masterkey deploykey servicekey sshkey tlskey sslkey clientkey storagekey".split())
#: Parts of names before ``token`` and ``key`` that speak of anything but a secret.
HARMLESS = frozenset("public primary foreign sort partition cache routing row idempotency dedup hash object map group range shard lookup order next prev page cursor continuation sync start end stop pad mask eos bos unk sep cls max min num count csrf cancellation".split())
PREFIXES = re.compile(
    r"(?<![\w/+])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|xox[abprs]-[\w\-]{10,}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]*"
    r"|(?:sk|rk|pk)_live_[0-9A-Za-z]{16,}|AIza[\w\-]{35}|npm_[A-Za-z0-9]{36}|[a-z]{2,6}_(?:live|test)_[0-9a-f]{24,64})(?![\w])"
)
PREFIX_HINTS = ("akia", "asia", "gho_", "ghp_", "ghs_", "ghr_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "eyj", "_live_", "_test_", "aiza", "npm_")
#: A short word and a long run of hex digits: an issued key, unless the word names what is no secret.
ISSUED = re.compile(r"(?<![\w/+.\-])([a-z]{2,6})[.\-][0-9a-f]{24,64}(?!\w)")
_ISSUED_HINT = re.compile(r"[.\-][0-9a-f]{24}")
NOT_ISSUED = frozenset("sha md blake crc commit rev ref build trace span req run job img image blob etag uuid guid id hash digest sum object tree node doc page log file tmp cache layer pod".split())
_PEM_BEGIN = re.compile(r"-----BEGIN[ \xa0](?:[A-Z0-9]+[ \xa0]){0,3}PRIVATE[ \xa0]KEY(?:[ \xa0]BLOCK)?-----")
_PEM_END = re.compile(r"-----END[ \xa0](?:[A-Z0-9]+[ \xa0]){0,3}PRIVATE[ \xa0]KEY(?:[ \xa0]BLOCK)?-----")
_BLANKS = dict.fromkeys(map(ord, "\xa0\u2002\u2003\u2009\u202f\u3000"), " ")
_PEM_REST = re.compile(r"(?:[\s\\nr]|[A-Za-z0-9+/=]{16,}|\w[\w\-]*: [^\n]*)*")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:<[^>]*>?|\$\{.*|\$\(.*|\$[a-z_]\w*$|\$\w{1,2}\$.*|\{\{.*|%\w+%$|%\(\w+\)[sdr]$|%[sdv]$|[*.x•]{3,}|.*(?:replace|change|fill|insert)[-_ ]?(?:me|this|it|in).*|your[-_ ].*|.*\byour[-_].*|example.*|.*EXAMPLE(?:KEY)?$|dummy.*|todo.*|redacted"
    r"|placeholder.*|none|null|nil|true|false|undefined|empty|os\.(?:environ|getenv).*|process\.env.*|env[.\[(].*|getenv.*|vault[.:/(].*|secrets?[.:/(].*|config[.\[(].*|settings[.\[(].*|arn:.*|sha\d+[:\-].*|data:.*|https?://.*|ref\+.*|![A-Za-z]+(?:[\s:.].*)?|file:.*)$"
)
_SEP = re.compile(r"[\"'`\])]{0,3}[ \t\xa0]*(?::=|=>|=(?!=)|:(?!:)|,(?=[ \t]*[\"'`])|>(?![>=]))[ \t\xa0]*(?:Bearer[ \t\xa0]+|Basic[ \t\xa0]+)?", re.I)
_QUOTED = re.compile(r"(?:[bruf]{1,2})?([\"'`])((?:\\.|(?!\1)[^\\\n])*)\1")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\.|\\)?[ \t]*\n?[ \t]*(?:\+[ \t]*)?(?=[\"'`])")
_BARE = re.compile(r"[^\s\"'`<>,;]+")
_PASSPHRASE = re.compile(r"[a-z]{3,}(?:-[a-z]{3,}){2,}$")
_AUTH = re.compile(r"(?i)authorization[\"']?\s*[:,=]\s*[\"'`]?\s*(?:bearer|basic|token)\s+([A-Za-z0-9+/=_\-.~]{8,})")
_URL = re.compile(r"[a-z][a-z0-9+.\-]*://[^\s:/@\"'<>]*:([^\s/\"'<>][^\s\"'<>]*?)@(?=[\w\-\[])", re.I)
_NETRC = re.compile(r"(?i)login\s+\S+\s+password\s+(\S+)")
_COMMAND = re.compile(r"(?:[^\n\\]|\\[\s\S]?)*")  # to the end of the line, or of the last line it is continued on
_OPTIONS = {
    "curl": re.compile(r"\s(?:-u|--user)[ =\xa0]+[\"']?[^\s:\"'/]+:([^\s\"']{4,})"),
    "sshpass": re.compile(r"\s-p\s*[\"']?([^\s\"']{4,})"),
    "redis-cli": re.compile(r"\s-a\s+[\"']?([^\s\"']{4,})"),
}
_SET = re.compile(r"[ \t]+([\"'`])([^\"'`\n]+)\1")
_SAID = re.compile(r"\s+(?:is|was)\s+([^\s\"'`,;]+?)(?=[,.;]?(?:\s|$))")
_BLOCK = re.compile(r"[\"']?\s*\{\s*(?:[a-z_]+\s*=\s*(?!\")\S+\s+|description\s*=\s*\"[^\"\n]*\"\s+)*default\s*=\s*\"([^\"\n]+)\"")
_VALUE_LINE = re.compile(r"[\"']?[ \t]*\r?\n[ \t]*[\"']?value[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"']+)")
_KIND = re.compile(r"kind:\s*[\"']?Secret[\"']?[ \t]*(?:#.*)?$", re.I)
_SECTION = re.compile(r"(?:stringData|data):[ \t]*(?:#.*)?$", re.I)
_ENTRY = re.compile(r"[\"']?[\w.\-/]+[\"']?:(?:[ \t]+|$)(?P<v>(?P<q>[\"'])(?P<in>(?:\\.|(?!(?P=q)).)*)(?P=q)?|[|>][+\-\d]*[ \t]*(?:#.*)?$|[^\s#].*?(?=[ \t]+#|[ \t]*$))?")
_PUBLIC = re.compile(r"\s*-----BEGIN (?:TRUSTED |X509 )?(?:CERTIFICATE|PUBLIC KEY)")
_LITERAL = re.compile(r"(?<![A-Za-z0-9+/_\-%\\])(?:[A-Za-z0-9+/_\-]{24,}={0,2}|(?:\\x[0-9a-fA-F]{2}){8,}|(?:\\u00[0-9a-fA-F]{2}){8,})(?![A-Za-z0-9+/=_%])")
_WRAPPED = re.compile(r"(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]{4,}={0,2}(?![^\s\"'`,;)\]}<]))+")
_PERCENT, _ESCAPED = re.compile(r"[\w.\-~%+]*%[0-9A-Fa-f]{2}[\w.\-~%+]*"), re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2}){4}")
_NO_LAYER = re.compile(r"(?i)(?:;base64,|sha\d*[:\-]|integrity)$")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in STEMS:
        a.add_word(w, (len(w), "stem"))
    for w in PREFIX_HINTS:
        a.add_word(w, (len(w), "prefix"))
    for w in ("?key=", "&key=", "?sig=", "&sig=", "?signature=", "&signature="):
        a.add_word(w, (len(w) - 1, "param"))
    a.add_word("private key", (11, "pem"))
    a.add_word("://", (3, "url"))
    a.add_word("login ", (6, "netrc"))
    for w in ("kind: secret", 'kind: "secret"', "kind: 'secret'"):
        a.add_word(w, (len(w), "manifest"))
    for w in ("curl ", "sshpass ", "redis-cli "):
        a.add_word(w, (len(w), "user"))
    a.make_automaton()
    return a


_PATH = re.compile(r"(?:[A-Za-z]:|~|\.{1,2})?(?:/(?:[a-z0-9._\-]+|[A-Z0-9._\-]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*)?)+")
_CAMEL = re.compile(r"[a-z]+(?:[A-Z][a-z]+)+|(?:[A-Z][a-z]+)+")


def spoken(v: str) -> bool:
    """A name in camel case whose parts are long enough to be words."""
    if not _CAMEL.fullmatch(v):
        return False
    parts = re.findall(r"[A-Z]?[a-z]+", v)
    return len(v) >= 3.5 * len(parts) or sum(len(x) < 3 for x in parts) < 2


def strong(v: str) -> bool:
    """Looks generated: long, and of mixed character classes or pure hex."""
    if len(v) < 10 or v.isdigit():
        return False
    if re.fullmatch(r"[0-9a-f]{24,}", v):
        return True
    classes = bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^\w\s]", v))
    switches = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(v, v[1:]))
    if len(v) >= 20 and v.isalpha() and v.isascii() and 3 * switches >= len(v):
        return True  # letters of either case at random: far more changes than in the words of a name
    return classes >= 3 and switches >= max(3, len(v) // 6) and not re.search(r"[/.](?:py|go|rs|ts|java)$|\(", v)


def secret_value(v: str, sure: bool, quoted: bool) -> bool:
    """Whether a value assigned to a key of a secret is one."""
    if len(v) < 6 or v.isdigit() or _PLACEHOLDER.match(v) or " " in v.strip() or re.fullmatch(r"\$2[aby]?\$.*|[\W_]+", v) or _PATH.fullmatch(v):
        return False
    if PREFIXES.fullmatch(v) or strong(v) or ISSUED.fullmatch(v):
        return True
    if not sure or "(" in v or "[" in v[:-1] and not quoted:
        return False
    if _PASSPHRASE.match(v):
        return True
    mixed = bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v))
    special = bool(re.search(r"[!#$%^&*?@+~]", v))
    if quoted:
        odd = sum(a.islower() and b.isupper() for a, b in zip(v, v[1:])) >= 1 and not spoken(v)
        return mixed or special or odd
    if len(v) >= 12 and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v) and any(map(readable, decoded(v))):
        return True
    return len(v) >= 8 and (mixed or special) and not re.fullmatch(r"[a-z]+(?:_[a-z]+)*\d{0,2}|[\w\-]+(?:/[\w\-.]+)+|\d+(?:\.\d+)?\w{1,3}", v)


def named(word: str) -> tuple[str | None, bool]:
    """The name without punctuation, and whether it is surely that of a secret; None if it speaks of something else."""
    parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", word)]
    name = "".join(parts)
    if not parts or parts[-1] in ("key", "token", "auth") and any(x in HARMLESS for x in parts[:-1]):
        return None, False
    sure = name.endswith(SURE) or parts[-1] in ("pw", "pass", "token", "secret") and (len(parts) < 3 or word.isupper() or parts[-1] != "token")
    return name, sure or re.fullmatch(r"(?:admin|db|root|user|smtp|ftp|mail|my)(?:pw|pass)", name) is not None


class Scanner:
    """Secret spans (start, end, kind) of a text."""

    def __init__(self):
        self.hints = _automaton()

    def finds(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        low = low.translate(_BLANKS) if not low.isascii() else low  # hints also match over odd blanks
        out: list[tuple[int, int, str]] = []
        shell, pem, prefix, url = -1, False, False, False
        for end, (size, kind) in self.hints.iter(low):
            if kind == "stem":
                self._assigned(text, low, end - size + 1, end + 1, out)
            elif kind == "param":
                self._value(text, end + 1, False, out, param=True)
            elif kind == "pem":
                pem = True
            elif kind == "prefix":
                prefix = True
            elif kind == "url":
                url = True
            elif kind == "user":
                at = end - size + 1
                if at >= shell and (not at or not low[at - 1].isalnum()):
                    shell = _COMMAND.match(text, at).end()
                    for m in _OPTIONS[low[at:end]].finditer(text, end, shell):
                        if not _PLACEHOLDER.match(m[1]):
                            out.append((m.start(1), m.end(1), "password"))
            elif kind == "manifest":
                for a, b in manifest_values(text, end - size + 1):
                    if not _PLACEHOLDER.match(text[a:b]) and b - a >= 8 and not _public(text[a:b]):
                        out.append((a, b, "value"))
            else:
                m = _NETRC.match(text, end - size + 1)
                if m and not _PLACEHOLDER.match(m[1]):
                    out.append((m.start(1), m.end(1), "password"))
        if pem:
            for a, b in armoured(text):
                out.append((a, b, "private_key"))
        if _ISSUED_HINT.search(low):
            for m in ISSUED.finditer(text):
                if m[1] not in NOT_ISSUED:
                    out.append((m.start(), m.end(), "token"))
        if prefix:
            for m in PREFIXES.finditer(text):
                if not _PLACEHOLDER.match(m[0]):
                    out.append((m.start(), m.end(), "token"))
        if url:
            for m in _URL.finditer(text):
                if not _PLACEHOLDER.match(m[1]) and len(m[1]) >= 4:
                    out.append((m.start(1), m.end(1), "password"))
        self._layers(text, out)
        return _settled(out)

    def _assigned(self, text: str, low: str, at: int, end: int, out: list) -> None:
        n = len(low)
        a = at
        while a and (low[a - 1].isalnum() or low[a - 1] in "_-"):
            a -= 1
        if end < n and (low[end].isalnum() or low[end] in "_-"):
            return  # a longer name: token_count, secret_name, password_hash
        while a and low[a - 1] == " " and low[a - 4 : a - 1] in ("api", "ess", "ate", "ret", "ing") and low[a:end] in ("key", "token"):
            a = low.rfind(" ", 0, a - 1) + 1  # api key, access key, private key, secret key, signing key
        name, sure = named(text[a:end])
        if name is None:
            return
        if name == "authorization":
            m = _AUTH.match(text, a)
            if m and not _PLACEHOLDER.match(m[1]):
                out.append((m.start(1), m.end(1), "header"))
            return
        m = _SEP.match(text, end)
        if m:
            self._value(text, m.end(), sure, out, param=a > 0 and text[a - 1] in "?&")
        else:
            m = _SET.match(text, end)
            if m and re.search(r"\bset$", low[max(0, (b := _bare_end(text, a)) - 4) : b]) and secret_value(m[2], sure, True):
                out.append((m.start(2), m.end(2), "value"))
            m = _SAID.match(text, end)
            if m and secret_value(m[1], True, len(m[1]) >= 8):
                out.append((m.start(1), m.end(1), "value"))
            m = _BLOCK.match(text, end)
            if m and secret_value(m[1], sure, True):
                out.append((m.start(1), m.end(1), "value"))
        m = _VALUE_LINE.match(text, end)
        if m and secret_value(m[1], sure, True):
            out.append((m.start(1), m.end(1), "value"))

    @staticmethod
    def _value(text: str, at: int, sure: bool, out: list, param: bool) -> None:
        m = _QUOTED.match(text, at)
        if m:
            value, start, stop = m[2], m.start(2), m.end(2)
            pos = m.end()
            while True:  # a value joined from several literals
                j = _JOIN.match(text, pos)
                nxt = _QUOTED.match(text, j.end()) if j and j.end() > pos and ("+" in j[0] or "\\" in j[0] or j[0].strip() == ".") else None
                if not nxt:
                    break
                value, stop, pos = value + nxt[2], nxt.end(2), nxt.end()
            plain = value.replace("\\n", "\n")
            if "-----BEGIN" in plain:
                return
            if secret_value(value, sure, True):
                out.append((start, stop, "value"))
            return
        m = _BARE.match(text, at)
        if m:
            value = m[0]
            if param and "&" in value:
                value = value.split("&")[0]
            value = value.rstrip(")}]\\") if value[:1] not in "$<{" else value
            if secret_value(value, sure, False):
                out.append((m.start(), m.start() + len(value), "value"))

    def _layers(self, text: str, out: list) -> None:
        known = sorted((a, b) for a, b, _ in out)
        starts = [a for a, _ in known]

        def inside(at: int) -> bool:
            i = bisect.bisect_right(starts, at)
            return any(a <= at < b for a, b in known[max(0, i - 3) : i])  # finds hardly overlap

        done = tried = -1
        for m in _LITERAL.finditer(text):
            if m.start() < done or inside(m.start()) or _NO_LAYER.search(text[max(0, m.start() - 16) : m.start()]):
                continue
            more = _WRAPPED.match(text, m.end()) if m.start() >= tried and text[m.end() : m.end() + 1] in ("\n", "\r") else None
            lines = more[0].split() if more else []
            if len(lines) > 1 and len(lines[0]) != len(m[0]):
                more = None  # a line of another kind before wrapped ones
            if more:
                tried = more.end()  # a block is joined once, from its first line
            if more and (kind := self._encoded(m[0] + "".join(lines))):
                out.append((m.start(), more.end(), kind))
                done = more.end()
            elif kind := self._encoded(m[0]):
                out.append((m.start(), m.end(), kind))
        if "%" in text:
            for m in _PERCENT.finditer(text):
                if _ESCAPED.search(m[0]) and not inside(m.start()) and (kind := self._encoded(m[0])):
                    out.append((m.start(), m.end(), kind))

    def _encoded(self, literal: str) -> str | None:
        """What a literal holds: a key container, or text with a secret in it."""
        for raw in decoded(literal):
            if key_container(raw):
                return "encoded_key"
            inner = readable(raw)
            if inner and self.finds(inner):
                return "encoded"
        return None


def _bare_end(text: str, at: int) -> int:
    """Where the text before a place ends without its blanks."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def armoured(text: str) -> list[tuple[int, int]]:
    """Private keys in armour, of any length; one without a closing line reaches as far as it looks like a key."""
    out, done = [], -1
    for m in _PEM_BEGIN.finditer(text):
        if m.start() < done:
            continue
        following = text.find("-----BEGIN", m.end())
        end = _PEM_END.search(text, m.end(), following if following >= 0 else len(text))
        done = end.end() if end else _PEM_REST.match(text, m.end()).end()
        out.append((m.start(), done))
    return out


def decoded(literal: str) -> list[bytes]:
    """Byte strings that a literal may stand for."""
    out = []
    if "%" in literal:
        return [unquote(re.sub(r"%(?:25)+(?=[0-9A-Fa-f]{2})", "%", literal)).encode("utf-8", "replace")]  # all percent layers at once
    if literal.startswith("\\x") or literal.startswith("\\u"):
        return [bytes(int(h, 16) for h in re.findall(r"(?:\\x|\\u00)([0-9a-fA-F]{2})", literal))]
    if len(literal) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", literal):
        out.append(bytes.fromhex(literal))
    body = literal.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1:
        try:
            out.append(base64.b64decode(body + "=" * (-len(body) % 4), validate=True))
        except (binascii.Error, ValueError):
            pass
    return out


def readable(raw: bytes) -> str | None:
    """The text of bytes that are UTF-8 without control characters."""
    if len(raw) < 8:
        return None
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\t\n\r\xa0\xad\u200b\u202f\u3000\ufeff" for c in text) else None


def _lines(text: str, at: int, step: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines after (or before) the one that holds a place."""
    while True:
        if step > 0:
            lo = text.find("\n", at) + 1
            if not lo or lo >= len(text):
                return
        else:
            hi = text.rfind("\n", 0, at)
            if hi < 0:
                return
            lo = text.rfind("\n", 0, hi) + 1
        end = text.find("\n", lo)
        end = len(text) if end < 0 else end
        yield lo, end - (text[end - 1 : end] == "\r" and end > lo)
        at = lo


def manifest_values(text: str, at: int) -> list[tuple[int, int]]:
    """Values under data and stringData of the Kubernetes Secret whose ``kind:`` stands at a place, in any order of the keys.

    The manifest is walked by lines both ways, to a ``---`` or a fence, to the manifest before or after, and in a list to the ends of its item.
    """
    start = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    if not _KIND.match(text[at : len(text) if end < 0 else end].rstrip("\r")):
        return []
    lead = text[start:at]
    own = len(lead) if not lead.strip(" \t-") else len(lead) - len(lead.lstrip())

    def parts(lo: int, hi: int) -> tuple[int, int]:
        """(indent of the content behind a list dash, indent)"""
        line = text[lo:hi]
        raw = len(line) - len(line.lstrip(" \t"))
        dash = re.match(r"[ \t]*-[ \t]+(?=\S)", line)
        return (dash.end() if dash else raw), raw

    def key(lo: int, hi: int, name: str) -> bool:
        inner, _ = parts(lo, hi)
        return inner == own and text.startswith(name, lo + inner)

    lines, versioned = [(start, len(text) if end < 0 else end)], False
    if "-" not in lead:
        for lo, hi in _lines(text, start, -1):
            inner, raw = parts(lo, hi)
            if text.startswith(("---", "```"), lo + raw) or key(lo, hi, "kind:") or text[lo:hi].strip() and inner < own:
                break
            lines.append((lo, hi))
            if raw < own and inner == own:
                break
            if key(lo, hi, "apiVersion:"):
                versioned = True
                break
    lines.sort()
    for lo, hi in _lines(text, start, 1):
        _, raw = parts(lo, hi)
        if text.startswith(("---", "```"), lo + raw) or key(lo, hi, "kind:") or versioned and key(lo, hi, "apiVersion:") or text[lo:hi].strip() and raw < own:
            break
        lines.append((lo, hi))
    out: list[tuple[int, int]] = []
    section, entry, open_end = False, None, ""
    for lo, hi in lines:
        inner, raw = parts(lo, hi)
        if not text[lo:hi].strip():
            continue
        if inner <= own:
            section, entry, open_end = bool(_SECTION.match(text[lo + inner : hi])) and inner == own, None, ""
            continue
        if not section:
            continue
        if entry is not None and raw > entry:  # the value goes on
            if open_end == "any" or open_end == "code" and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", text[lo:hi].strip()):
                a = out[-1][0] if out[-1][0] >= 0 else lo + raw
                out[-1] = (a, lo + len(text[lo:hi].rstrip(" \t\"'")))
            continue
        m = None if text[lo + raw] == "#" else _ENTRY.match(text[lo:hi], raw)
        if m:
            entry, open_end = raw, ""
            value = m["v"] or ""
            if m["q"]:
                out.append((lo + m.start("in"), lo + m.end("in")))
                open_end = "" if len(m["v"]) > 1 and m["v"].endswith(m["q"]) else "any"
            elif not value or value[0] in "|>":
                out.append((-1, -1))
                open_end = "any"
            else:
                out.append((lo + m.start("v"), lo + m.end("v")))
                open_end = "code" if re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value) else ""
    return [(a, b) for a, b in out if a >= 0]


def _public(value: str) -> bool:
    """A certificate or public key, plain or encoded."""
    if _PUBLIC.match(value):
        return True
    plain = re.sub(r"\s", "", value)
    return plain.startswith("LS0tLS1CRUdJTi") and any(_PUBLIC.match(r.decode("latin-1")) for r in decoded(plain))


def _der(raw: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at a place, if it fits."""
    if at + 2 > len(raw):
        return None
    tag, n, at = raw[at], raw[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(raw):
            return None
        n, at = int.from_bytes(raw[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= len(raw) else None


def key_container(raw: bytes) -> bool:
    """A private key in DER (PKCS#1, PKCS#8, SEC1, encrypted PKCS#8) or OpenSSH form."""
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    top = _der(raw, 0)
    if not top or top[0] != 0x30 or len(raw) - top[2] > 4 or top[2] - top[1] < 32:
        return False
    parts, at = [], top[1]
    while at < top[2] and len(parts) < 12:
        p = _der(raw, at)
        if not p:
            return False
        parts.append(p)
        at = p[2]
    tags = [p[0] for p in parts]
    version = parts[0][0] == 2 and parts[0][2] - parts[0][1] == 1 and raw[parts[0][1]] in (0, 1)
    pkcs1 = version and len(tags) >= 9 and set(tags[:9]) == {2}
    pkcs8 = version and tags[1:3] == [0x30, 0x04]
    sec1 = version and raw[parts[0][1]] == 1 and tags[1:2] == [0x04]
    sealed = len(tags) == 2 and tags == [0x30, 0x04] and raw[parts[0][1] : parts[0][1] + 1] == b"\x06"
    return pkcs1 or pkcs8 or sec1 or sealed


def _settled(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return settled(found, lambda f: (f[2] != "private_key", f[0], -f[1]))


def masked(text: str, finds: list[tuple[int, int, str]]) -> str:
    for a, b, k in reversed(finds):
        body = text[a:b]
        if k == "private_key":
            lines = re.split(r"(\r?\n|\\n)", body)
            body = "".join(x if x.strip().startswith("-----") or x in ("\n", "\r\n", "\\n") else re.sub(r"[A-Za-z0-9+/=]", "*", x) for x in lines)
        else:
            body = "".join(re.sub(r"[^\s]", "*", x) if i % 2 == 0 else x for i, x in enumerate(re.split(r"([\"'`]\s*[+.\\]?\s*[\"'`])", body)))
        text = text[:a] + body + text[b:]
    return text


def find_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(record_id, start_pos, end_pos, secret_kind), each find once. Map-only but for the removal of repeats among the finds."""
    rows = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner()
        for batch in batches:
            out = [(r, a, b, k) for r, t in zip(batch["record_id"], batch["body"]) for a, b, k in s.finds(t)]
            yield pd.DataFrame(out, columns=["record_id", "start_pos", "end_pos", "secret_kind"])

    found = rows.where(F.col("record_id").isNotNull() & (F.length("body") >= 8))
    return found.mapInPandas(run, "record_id string, start_pos long, end_pos long, secret_kind string").distinct()


def mask_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(record_id, masked, finds): every row with its secrets masked in place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner()
        for batch in batches:
            all_finds = [s.finds(t) if t else [] for t in batch["body"]]
            yield pd.DataFrame({
                "record_id": batch["record_id"],
                "masked": [masked(t, f) if f else t for t, f in zip(batch["body"], all_finds)],
                "finds": [[{"start_pos": a, "end_pos": b, "secret_kind": k} for a, b, k in f] for f in all_finds],
            })

    rows = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("body"))
    return rows.mapInPandas(run, "record_id string, masked string, finds array<struct<start_pos:bigint,end_pos:bigint,secret_kind:string>>")
