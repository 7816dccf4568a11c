"""Credentials embedded in source text: find them, list their lines, splice placeholders.

Token formats, key armor and the grammars of connection strings and headers are compiled into one deterministic automaton
(``dfa.Dfa``). The literal beginnings of all its grammars, with the names of secrets, are the words of an Aho-Corasick
automaton that reads each text once; where a beginning ends, the deterministic automaton goes on from its first character
and gives every grammar's longest match and where its value begins, reading each character once. After a name of a secret
an anchored grammar reads the assignment and its literal, with its adjoined parts. Word lists only filter what was found.

Defined results
* null or empty text: no span. Very long texts are read in one pass, never cut.
* a value found by several grammars counts once (the longest span from its first character).
* repeated rows count once, tombstoned rows count like others; rows whose id is null are left out.
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- grammars ----------------------------------------------------------------------------------------------------

#: Token formats: beginning (lower case, as in the automaton) and the whole form. The last group are no format published
#: by a vendor that we know of: the common form ``name_`` or ``name_live_`` before random letters, for names in use.
TOKEN_FORMATS = {
    "xoxa-": r"xoxa-[0-9A-Za-z-]{20,}",
    "xoxb-": r"xoxb-[0-9A-Za-z-]{20,}",
    "xoxp-": r"xoxp-[0-9A-Za-z-]{20,}",
    "xoxr-": r"xoxr-[0-9A-Za-z-]{20,}",
    "xoxs-": r"xoxs-[0-9A-Za-z-]{20,}",
    "xapp-": r"xapp-[0-9A-Za-z-]{20,}",
    "ghp_": r"ghp_[0-9A-Za-z]{20,}",
    "gho_": r"gho_[0-9A-Za-z]{20,}",
    "ghu_": r"ghu_[0-9A-Za-z]{20,}",
    "ghs_": r"ghs_[0-9A-Za-z]{20,}",
    "ghr_": r"ghr_[0-9A-Za-z]{20,}",
    "github_pat_": r"github_pat_[0-9A-Za-z_]{22,}",
    "glpat-": r"glpat-[0-9A-Za-z_-]{20,}",
    "npm_": r"npm_[0-9A-Za-z]{30,}",
    "pypi-": r"pypi-[0-9A-Za-z_-]{40,}",
    "sk_live_": r"sk_live_[0-9A-Za-z]{16,}",
    "rk_live_": r"rk_live_[0-9A-Za-z]{16,}",
    "sk_test_": r"sk_test_[0-9A-Za-z]{16,}",
    "sk-": r"sk-[0-9A-Za-z_-]{32,}",
    "key-": r"key-[0-9A-Za-z]{30,}",
    "hf_": r"hf_[0-9A-Za-z]{30,}",
    "dop_v1_": r"dop_v1_[0-9a-f]{40,}",
    "shpat_": r"shpat_[0-9a-fA-F]{32}",
    "aiza": r"AIza[0-9A-Za-z_-]{35}",
    "ya29.": r"ya29\.[0-9A-Za-z_-]{20,}",
    "sg.": r"SG\.[0-9A-Za-z_-]{20,}\.[0-9A-Za-z_-]{20,}",
    "eyj": r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}(?:\.[0-9A-Za-z_-]+)?",
    "pat_": r"pat_(?:live_)?[0-9A-Za-z]{20,}",
    "ndl_": r"ndl_[0-9A-Za-z]{20,}",
}
#: The other grammars of the automaton: (name, beginnings, form). The group v is where the value begins.
FORMS = (
    ("armor", ("-----begin ",), r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    ("url", ("://",), r"://[^\s:/@\"'`<>{}$]*:(?P<v>[^\s@\"'`<>/]+(?:/[^\s@\"'`<>/]+)*)@"),
    ("bearer", ("bearer ", "bearer\t"), r"(?i)bearer[ \t]+(?P<v>[A-Za-z0-9._~+/=-]{16,})"),
    ("basic", ("basic ", "basic\t"), r"(?i)basic[ \t]+(?P<v>[A-Za-z0-9+/]{12,}={0,2})"),
    ("key_pair", ("akia", "asia"), r"(?:AKIA|ASIA)[A-Z0-9]{16}[\"'`]?[ \t]*(?:,|:|/|;|\||[ \t]and[ \t])[ \t]*(?:[A-Za-z0-9_]+[ \t]*[=:][ \t]*)?[\"'`]?(?P<v>[A-Za-z0-9+/]{40})"),
    ("user", ("-u ", "-u\t"), r"-u[ \t]+[\"']?[^\s:\"'$<{]+:(?P<v>[^\s\"'`]+)"),
)
#: Names after which a value may be a secret.
SECRET_NAMES = (
    "password passwd passphrase pass pwd pw secret token apikey api_key api-key access_key accesskey access-key auth_key "
    "authkey signing_key signingkey signing-key private_key privatekey credential credentials creds encryption_key auth"
).split()
#: Values that stand for a secret without being one.
PLACEHOLDERS = re.compile(
    r"""(?ix)^(?: x{3,}|\*{3,}|\.{3,}|-{3,}|_{3,}|0{6,}|\#{3,}|•{3,}
    | .*(?:change[_-]?me|changeit|replace[_-]?(?:me|this|with)|place[_-]?holder|redacted|your[_-]|_here$|-here$|example|dummy|insert[_-]|to[_-]?be[_-]?(?:set|filled)|fill[_-]?(?:me|in)|not[_-]a[_-]real|removed|masked|hidden).*
    | <.*>|\[.*\]|\{.*\}|\$.*|%.*%|%\(.*|@.*@ | .*\$\{.*|.*\{\{.*
    | todo|tbd|fixme|none|null|nil|undefined|true|false|empty|unset|secret|password|passwd|token|api[_-]?key|pass|pwd|test|foo|bar|baz|user|username|root|admin|default|string|text|value|optional|required
    )$"""
)
LOOKUPS = re.compile(
    r"""(?ix)^(?: (?:vault|kms|ssm|secretsmanager|arn|env|secretref|ref|file|op|gcpsm|awssm|keyring|pass|bws|doppler)[:/].* | secrets?/.* | .*\b(?:environ|getenv|process\.env|env::var)\b.* )$"""
)
PATHS = re.compile(r"(?:\.{1,2}|~)?(?:/[a-z0-9_.-]+){2,}/?")
DIGESTS = re.compile(
    r"(?i)^(?:sha(?:1|224|256|384|512)[-:].*|md5[-:].*|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|data:.*|urn:.*|ssh-(?:rsa|ed25519).*)$"
)
#: Last words of a name that make its value something about a secret, not the secret.
HARMLESS_LAST = frozenset(
    "label path hint template name names file field fields id ids ref url uri env var title prompt policy length len min max ttl expiry regex pattern hash digest "
    "checksum sum count type kind header prefix suffix format dir folder store provider manager class help text message error placeholder rules rule column table "
    "index map list set parser reader writer scope scopes endpoint host port version age days hours seconds alias text desc description note tooltip icon style".split()
)

_MASK = re.compile(r"(?i)x{6,}|\*{4,}|\.{4,}|example|0{10,}|(.)\1{7,}")
_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOR_BODY = re.compile(r"""(?:\\n|\\r|[\s"'`+,;#*/]|//)*((?:[A-Za-z0-9+/=]{4,}|[A-Za-z-]+: [^\n\\]+)(?:(?:\\n|\\r|[\s"'`+,;#*/.()\\:]|//|-(?!----))*(?:[A-Za-z0-9+/=,:]+))*)""")
_NAME_ON = re.compile(r"[A-Za-z0-9_-]*")
#: What may stand between a name and its value: closing quote, a type, an assignment sign.
_ASSIGN = re.compile(
    r"""["'`]?\]?[ \t]*(?::[ \t]*&?(?:'static[ \t]+)?(?:str|String|string|std::string|Option<[^>\n]*>)[ \t]*=|\[[^\]\n]*\][ \t]*=|:=|=>|={1,3}|:|(?=[ \t]+[A-Za-z0-9"'`+/=!@#$%&*?]))[ \t]*"""
)
_OPEN = re.compile(r"""[\[(]?[ \t]*(?:concat!\([ \t\n]*|String::from\(|new[ \t]+String\(|[bBrRuUfF]{1,2}(?=["'])|@(?="))?(r?\#*)?(\"\"\"|'''|["'`])""")
_JOIN = re.compile(r"""[ \t]*(?:\\?[ \t]*\r?\n[ \t]*)?(?:\+|,|\.\.|\.|<>|&)?[ \t]*(?:\r?\n[ \t]*)?(?:\+[ \t]*)?(["'`])""")
_BARE = re.compile(r"""[^\s"'`,;<>(){}\[\]|]+""")
_FLAG = re.compile(r"""--?[A-Za-z][\w-]*\Z""")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_WORDY = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")
_CALL_LOGIN = re.compile(r"""\(\s*["']([^"'\n]+)["']\s*,\s*(["'])((?:(?!\2)[^\n\\])+)\2\s*[,)]""")
_LOGIN_PROSE = re.compile(r"""(?:[ \t]+as)?[ \t]+(\S+)[ \t]+(?:(?:with|and|using)[ \t]+(?:the[ \t]+)?(?:password|passphrase|token|pass)[ \t]+|/[ \t]+|:[ \t]*)?[`"']?([^\s`"'@,;]+)""")
_CREDS = re.compile(r"""[ \t]*(?:are|is|=|:)?[ \t]*["'`]?([A-Za-z_][\w.-]*)[ \t]*[:/][ \t]*([^\s"'`,;]+)""")
_PROSE = re.compile(r"""[ \t]+(?:was|is|to|equals)?[ \t]*[`"']?([^\s`"',;<>()]+)""")
_USE = re.compile(r"""[ \t]+[`"']?([A-Za-z0-9+/_=.!@#$%^&*?~-]{8,})[`"']?[ \t]+until\b""")


def looks_random(v: str) -> bool:
    """A string no one writes as a word: mixed classes, or letters and digits mixed."""
    if len(v) < 8:
        return False
    up, low, dig = any(c.isupper() for c in v), any(c.islower() for c in v), any(c.isdigit() for c in v)
    if len(v) >= 20 and (up + low + dig) >= 2:
        return len(set(v)) >= 8
    return dig and (up or low)


_CASE_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PASSPHRASE = re.compile(r"[A-Za-z]+(?:[-.][A-Za-z]+){2,}")


def random_case(v: str) -> bool:
    """Letters whose case changes so often that no words are left: aPfBDerXNKof."""
    if len(v) < 8 or not v.isalpha() or v.islower() or v.isupper():
        return False
    return len(v) <= 3.2 * len(_CASE_RUN.findall(v))


def harmless(v: str) -> bool:
    """Placeholders, look-ups, digests, masked values."""
    return not v or len(set(v)) < 3 or bool(PLACEHOLDERS.match(v) or LOOKUPS.match(v) or PATHS.fullmatch(v) or DIGESTS.match(v))


def plausible(v: str, named: bool) -> bool:
    """Could ``v`` be a password or key? ``named``: it stands where only a secret can stand."""
    if len(v) < 6 or harmless(v) or any(c.isspace() for c in v) or any(ord(c) < 32 for c in v):
        return False
    if re.fullmatch(r"[A-Za-z_][\w]*(?:(?:\.|::|->)[A-Za-z_]\w*)+(?:\(.*)?", v) and not re.search(r"\d", v):
        return False  # a member of something: self.token, cfg::token()
    if re.search(r"[(){}<>\[\]]", v) and not named:
        return False
    if any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
        return True
    if _PASSPHRASE.fullmatch(v) or random_case(v):
        return True
    if re.fullmatch(r"[A-Za-z]+(?:_[A-Za-z]+)+", v):
        return False
    if re.search(r"[^\w]", v) and any(c.isalpha() for c in v) and not re.fullmatch(r"[\w./:-]+", v):
        return True
    return named and v.isalpha() and len(v) >= 8


def _literal(text: str, at: int, goes_on: bool = False) -> tuple[list[tuple[int, int]], int, str] | None:
    """The string literal that opens at ``at`` with its adjoined parts: spans of the parts, end, joined value.

    ``goes_on``: one that is still open at the end of the text counts, with an end beyond it."""
    m = _OPEN.match(text, at)
    if not m:
        return None
    q, spans, value = m[2], [], []
    pos = m.end()
    raw = "#" in (m[1] or "")
    while True:
        stop = text.find(q + ("#" * (m[1] or "").count("#") if raw else ""), pos)
        if stop < 0:
            if not goes_on or len(q) != 1 or "\n" in text[pos:] or not text[pos:]:
                return None
            return [*spans, (pos, len(text))], len(text) + 1, "".join([*value, text[pos:]])
        part = text[pos:stop]
        if len(q) == 1 and q != "`" and not raw and "\n" in part:
            return None
        spans.append((pos, stop))
        value.append(part)
        end = stop + len(q)
        j = _JOIN.match(text, end)
        if not j or len(q) != 1 or raw:
            return spans, end, "".join(value)
        joined = text[end : j.end()]
        if "," in joined and "concat!(" not in text[max(0, m.start() - 9) : m.end()]:
            return spans, end, "".join(value)
        if "." in joined and ".." not in joined:
            return spans, end, "".join(value)
        q, pos = j[1], j.end()


def _name_words(name: str) -> list[str]:
    return [w.lower() for w in _WORDY.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name))]


#: What the words of the first automaton stand for.
G_FORM, G_NAME, G_LOGIN, G_CREDS, G_USE = range(5)


class CredentialAutomaton:
    """The automata with what filters their finds. ``spans(text)``: (start, end, kind) of each credential value, in order.

    The parts of a value that is cut into adjoined literals are spans of their own; the kind of all but the first ends in +.
    ``goes_on``: the text is known to be cut off at its end, so an open literal, or a key's first line, counts as it stands.
    """

    def __init__(self) -> None:
        import ahocorasick

        from .dfa import Dfa

        self.kinds = [*TOKEN_FORMATS, *(name for name, _, _ in FORMS)]
        self.dfa = Dfa([*TOKEN_FORMATS.values(), *(form for _, _, form in FORMS)])
        a = ahocorasick.Automaton()
        for anchor in [*TOKEN_FORMATS, *(x for _, begins, _ in FORMS for x in begins)]:
            a.add_word(anchor, (G_FORM, anchor))
        for anchor, g in (("login", G_LOGIN), ("log in ", G_LOGIN), ("creds", G_CREDS), ("use ", G_USE), ("api key", G_NAME)):
            a.add_word(anchor, (g, anchor))
        for anchor in SECRET_NAMES:
            a.add_word(anchor, (G_CREDS if anchor == "creds" else G_NAME, anchor))
        a.make_automaton()
        self.automaton = a

    def spans(self, text: str | None, goes_on: bool = False) -> list[tuple[int, int, str]]:
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = text.translate(_ASCII_LOWER)
        found: list[tuple[int, int, str]] = []
        done = -1  # the end of the last name handled: 'pass' inside 'password' is not read again
        run = (0, 0)  # the stretch of name characters last walked back over
        for last, (g, anchor) in self.automaton.iter(low):
            start = last + 1 - len(anchor)
            if g == G_FORM:
                found += self._forms(text, start, goes_on)
            elif g == G_LOGIN:
                found += self._login(text, last + 1)
            elif g == G_CREDS and (m := _CREDS.match(text, last + 1)) and plausible(m[2], True):
                found.append((m.start(2), m.end(2), "password"))
            elif g == G_USE:
                if not start or not text[start - 1].isalnum():
                    m = _USE.match(text, last)
                    if m and plausible(m[1], False):
                        found.append((m.start(1), m.end(1), "token"))
            elif last > done or g == G_CREDS:
                end = _NAME_ON.match(text, last + 1).end()
                done = end - 1
                at = start
                while at and text[at - 1] in _NAME_CHARS:
                    if at == run[1]:
                        at = run[0]
                        break
                    at -= 1
                run = at, start
                found += self._named(text, at, start, end, goes_on)
        return _merge(found)

    def _forms(self, text: str, start: int, goes_on: bool) -> list[tuple[int, int, str]]:
        """What the deterministic automaton matches from ``start``."""
        out: list[tuple[int, int, str]] = []
        before = text[start - 1] if start else ""
        quoted = bool(before) and before in "\"'`"
        matched = self.dfa.run(text, start)
        tokens = [g for g in matched if g < len(TOKEN_FORMATS)]
        if not tokens and quoted and any(text[start : start + len(x)].lower() == x for x in TOKEN_FORMATS):
            lit = _literal(text, start - 1)  # a token whose literal is cut into adjoined parts
            if lit and len(lit[0]) > 1:
                out += self._parts(lit)
        for g, (value, end) in matched.items():
            v, kind = text[value:end], self.kinds[g]
            if g < len(TOKEN_FORMATS):
                if before.isalnum() or before == "_" or _MASK.search(v) or not looks_random(v[len(kind) :]):
                    continue
                lit = _literal(text, start - 1) if quoted else None
                out += (lit and len(lit[0]) > 1 and self._parts(lit)) or [(start, end, "token")]
            elif kind == "armor":
                b = _ARMOR_BODY.match(text, end)
                if b and len(re.sub(r"[^A-Za-z0-9+/=]", "", b[1])) >= 32:
                    out.append((start, b.end(), "private_key"))
                elif goes_on and text[end:].strip() in ("", "\\n", "\\"):
                    out.append((start, end, "private_key"))  # the block goes on in the next line
            elif kind == "url":
                if text[end : end + 1] and (text[end].isalnum() or text[end] in "_[<{$.-") and self._url_pass(text[start + 3 : value - 1], v[:-1]):
                    out.append((value, end - 1, "connection_password"))
            elif kind == "bearer":
                if looks_random(v) and not harmless(v) and not _MASK.search(v):
                    out.append((value, end, "bearer_token"))
            elif kind == "basic":
                if text[end : end + 1] not in tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=") and self._basic(v):
                    out.append((value, end, "basic_auth"))
            elif kind == "key_pair":
                if looks_random(v) and not _MASK.search(text[start : start + 20]) and not (text[end : end + 1].isalnum() or text[end : end + 1] in ("+", "/")):
                    out.append((value, end, "access_key"))
            elif plausible(v, True) and "curl " in text[text.rfind("\n", 0, start) + 1 : start].lower():
                out.append((value, end, "password"))
        return out

    def _parts(self, lit: tuple[list[tuple[int, int]], int, str]) -> list[tuple[int, int, str]]:
        """The parts of a literal whose joined value is a token."""
        v = lit[2]
        got = self.dfa.run(v, 0)
        for g, (_, end) in got.items():
            if g < len(TOKEN_FORMATS) and end == len(v) and not _MASK.search(v) and looks_random(v[len(self.kinds[g]) :]):
                return [(s, e, "token" + "+" * (i > 0)) for i, (s, e) in enumerate(lit[0])]
        return []

    @staticmethod
    def _url_pass(user: str, v: str) -> bool:
        if harmless(v) or len(v) < 4 or v[0] in "<{$%[" or "${" in v or v.lower() == user.lower():
            return False
        return not re.fullmatch(r"(?i)[a-z]*(?:pass|password|pwd|secret|token)[a-z]*", v)

    @staticmethod
    def _basic(v: str) -> bool:
        try:
            raw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
        except (ValueError, binascii.Error, UnicodeDecodeError):
            return False
        user, colon, pw = raw.partition(":")
        return bool(colon and user and pw and raw.isprintable()) and len(pw) >= 4 and not harmless(pw)

    @staticmethod
    def _login(text: str, at: int):
        m = _CALL_LOGIN.match(text, at)
        if m:
            return [(m.start(3), m.end(3), "password")] if plausible(m[3], True) else []
        m = _LOGIN_PROSE.match(text, at)
        if m and plausible(m[2], False) and not m[2].startswith("http"):
            return [(m.start(2), m.end(2), "password")]
        return []

    def _named(self, text: str, first: int, start: int, end: int, goes_on: bool = False):
        """The value assigned to the name from ``first`` to ``end``; the name of a secret in it begins at ``start``."""
        before = text[first:start]
        name = text[first:end]
        words = _name_words(name)
        if not words:
            return []
        flag = name.startswith("-") and bool(_FLAG.search(name))
        tail = words[-1]
        whole = name.lower().strip("-_.")
        secret = tail in ("password", "passwd", "passphrase", "pass", "pwd", "pw", "secret", "token", "apikey", "credential", "credentials", "creds", "auth") or re.search(r"(?:password|passwd|secret|token|apikey)$", whole)
        if not secret and tail == "key":
            secret = len(words) > 1 and words[-2] in ("api", "access", "secret", "auth", "signing", "private", "encryption", "account", "master")
        if not secret or (tail in HARMLESS_LAST):
            return []
        weak = tail in ("pass", "pw", "auth") and len(words) == 1
        m = _ASSIGN.match(text, end)
        if m:
            sign = m[0].strip(" \t\"'`]")
            lit = _literal(text, m.end(), goes_on)
            if lit and sign:
                spans, close, v = lit
                v = v.strip()
                if goes_on and (close > len(text) or _GOES_ON.fullmatch(text[close:])) and begins_secret(v):
                    return [(s, e, "secret" + "+" * (i > 0)) for i, (s, e) in enumerate(x for x in spans if x[1] > x[0])]
                if "\n" in v:
                    return []
                if plausible(v, False):
                    return [(s, e, "secret" + "+" * (i > 0)) for i, (s, e) in enumerate(x for x in spans if x[1] > x[0])]
                return []
            if lit:  # prose: the token `value`
                return [(s, e, "secret") for s, e in lit[0]] if plausible(lit[2], False) and "`\"'".find(text[lit[0][0][0] - 1]) >= 0 else []
            b = _BARE.match(text, m.end())
            if sign and b and not flag:
                v = b[0]
                line_end = text.find("\n", b.end())
                rest = text[b.end() : len(text) if line_end < 0 else line_end].strip()
                if sign.endswith(("=", ":")) and sign not in ("==", "===") and self._bare(v, rest, text[start - len(before) - 1 : start - len(before)] == ";"):
                    return [(b.start(), b.start() + len(v), "secret")]
            if flag and b:
                return [(b.start(), b.end(), "password")] if plausible(b[0], True) else []
            if not sign and not weak:
                p = _PROSE.match(text, end)
                v = p[1].rstrip(".") if p else ""
                if p and (looks_random(v) or random_case(v) or _PASSPHRASE.fullmatch(v)) and plausible(v, False):
                    return [(p.start(1), p.start(1) + len(v), "token")]
        return []

    @staticmethod
    def _bare(v: str, rest: str, named: bool) -> bool:
        """A value without quotes: YAML, env and ini files, connection strings."""
        if not plausible(v, named) or rest.startswith(("(", "{", "[")):
            return False
        return not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(?:[.:]+[A-Za-z_][A-Za-z0-9_]*)*", v) or looks_random(v) or random_case(v) or named


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def _merge(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping finds of one value become its longest span; the kind is the first grammar's."""
    out: list[tuple[int, int, str]] = []
    for s, e, k in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and s < out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, out[-1][2])
        else:
            out.append((s, e, k))
    return out


_SELF: CredentialAutomaton | None = None


def automaton() -> CredentialAutomaton:
    """One automaton for each Python worker."""
    global _SELF
    if _SELF is None:
        _SELF = CredentialAutomaton()
    return _SELF


# --- DataFrame operators -----------------------------------------------------------------------------------------

PLACEHOLDER = "REDACTED"


def _spans_batches(batches: Iterator[pd.DataFrame], spans=None) -> Iterator[pd.DataFrame]:
    spans = spans or automaton().spans
    for b in batches:
        rows: dict[str, list] = {k: [] for k in ("record_id", "first_line", "line_no", "start", "end", "kind", "key", "indent", "column")}
        for rid, first, key, text in zip(b["record_id"], b["first_line"], b["key"], b["text"]):
            line, at, begin, code = 0, 0, 0, None
            for s, e, kind in spans(text):
                n = text.count("\n", at, s)
                if n or code is None:
                    begin = text.rfind("\n", at, s) + 1 if n else 0
                    code = begin
                    while code < s and text[code].isspace():
                        code += 1
                line += n
                at = s
                for k, v in zip(rows, (rid, first, line, s, e, kind, key, code - begin, s - code)):
                    rows[k].append(v)
        if rows["record_id"]:
            yield pd.DataFrame(rows)


SPANS_SCHEMA = "record_id long, first_line int, line_no int, start int, end int, kind string, key string, indent int, column int"


def credential_spans(df: DataFrame, record_id: str, text: str, first_line: str | None = None, key: str | None = None) -> DataFrame:
    """The credential values in ``text``: (record_id, first_line, line_no, start, end, kind, key, indent, column).

    ``line_no`` counts from 0 within the text, ``start`` and ``end`` are character offsets, ``column`` is the value's
    offset from the first character of its line that is not blank, ``indent`` the number of blanks before that. ``key``
    is passed through (a file path, say).
    """
    d = df.select(
        F.col(record_id).cast("long").alias("record_id"),
        (F.col(first_line).cast("int") if first_line else F.lit(0)).alias("first_line"),
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        F.col(text).alias("text"),
    ).where("record_id is not null and text is not null and text <> ''")
    return d.mapInPandas(_spans_batches, SPANS_SCHEMA)


def credential_lines(df: DataFrame, record_type: str, record_id: str, text: str, first_line: str) -> DataFrame:
    """One row per line on which a credential value begins: (record_type, record_id, line_no)."""
    s = credential_spans(df, record_id, text, first_line)
    s = s.where("kind not like '%+'")  # the further parts of a value that is cut into adjoined literals
    return s.select(F.lit(record_type).alias("record_type"), "record_id", (F.coalesce("first_line", F.lit(1)) + F.col("line_no")).cast("int").alias("line_no")).distinct()


def issue_lines(issues: DataFrame) -> DataFrame:
    """As ``credential_lines`` for findings whose snippet is one line, trimmed and cut at 150 characters.

    A value cut off by the end of the snippet counts if its beginning (8 characters) shows.
    """
    d = issues.select("issue_id", "line", "snippet").where("snippet is not null")
    s = d.select(F.col("issue_id").cast("long").alias("record_id"), F.col("line").cast("int").alias("first_line"), F.lit(None).cast("string").alias("key"), F.col("snippet").alias("text")).where("record_id is not null")
    return s.mapInPandas(lambda bs: _spans_batches(bs, snippet_spans), SPANS_SCHEMA).where("kind not like '%+'").select(F.lit("issue").alias("record_type"), "record_id", F.col("first_line").alias("line_no")).distinct()


#: Snippets end here; what lies beyond is unknown.
SNIPPET_LENGTH = 150
#: After a closed literal: it goes on in the next line.
_GOES_ON = re.compile(r"\s*[+\\]?\s*")
_SHOWN = re.compile(r"[A-Za-z0-9]+(?:[-.!@#$%^&*?~+/=][A-Za-z0-9]*)+")


def begins_secret(v: str) -> bool:
    """Could a value that is cut off here be a secret? Eight characters must show, and more than one word."""
    return plausible(v, False) or len(v) >= 8 and not harmless(v) and bool(_SHOWN.fullmatch(v))


def snippet_spans(snippet: str) -> list[tuple[int, int, str]]:
    """As ``spans`` for a trimmed line that may be cut off at ``SNIPPET_LENGTH`` characters, or go on in the next line."""
    a = automaton()
    cut_off = len(snippet) >= SNIPPET_LENGTH or snippet.endswith(("'", '"', "`", "+", "\\")) or "-----BEGIN " in snippet
    return a.spans(snippet, cut_off)


def _redact_batches(batches: Iterator[pd.DataFrame], find=None) -> Iterator[pd.DataFrame]:
    find = find or automaton().spans
    for b in batches:
        out, n = [], []
        for text in b["text"]:
            spans = find(text)
            out.append(splice(text, spans))
            n.append(len(spans))
        yield pd.DataFrame({"record_id": b["record_id"], "n_values": n, "redacted": out})


_KEY_PARTS = re.compile(r"""(?P<keep>(?:\\)+[nr]|[\n\r])|(?P<quote>["'`]+)|(?P<run>[A-Za-z0-9+/=]+)""")


def _splice_key(body: str, comment: bool) -> str:
    """The body of a key block with every run of base64 replaced, however short.

    Signs alone are operators where they stand between literals; the armor stands within one if the body has quotes.
    ``comment``: each line begins with ``//``, which stays.
    """
    if comment:
        head, *lines = body.split("\n")
        mark = [re.match(r"[ \t]*(?://)?", x)[0] for x in lines]
        return "\n".join([_splice_key(head, False), *(k + _splice_key(x[len(k) :], False) for k, x in zip(mark, lines))])
    outside = False

    def part(m: re.Match) -> str:
        nonlocal outside
        if m["quote"]:
            outside ^= len(m["quote"]) % 2 == 1
        elif m["run"] and not (outside and not any(x.isalnum() for x in m["run"])):
            return PLACEHOLDER
        return m[0]

    return _KEY_PARTS.sub(part, body)


def splice(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each value replaced; quotes, armor and line breaks stay, so the code still parses."""
    parts, at = [], 0
    for s, e, kind in spans:
        parts.append(text[at:s])
        if kind == "private_key":
            m = _ARMOR.match(text, s)
            parts.append(m[0] + _splice_key(text[m.end() : e], text[text.rfind("\n", 0, s) + 1 : s].strip() == "//"))
        else:
            parts.append(PLACEHOLDER)
        at = e
    parts.append(text[at:])
    return "".join(parts)


def redact(df: DataFrame, record_id: str, text: str, snippets: bool = False) -> DataFrame:
    """(record_id, n_values, redacted): the texts that hold credentials with only the values replaced. ``snippets``: the
    texts are lines that may be cut off."""
    d = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).alias("text")).where("record_id is not null and text is not null and text <> ''")
    return d.mapInPandas((lambda bs: _redact_batches(bs, snippet_spans)) if snippets else _redact_batches, "record_id long, n_values int, redacted string").where("n_values > 0")


def absolute_spans(chunks: DataFrame) -> DataFrame:
    """Credential values by file: overlapping chunks find the same value, which counts once by its place in the file.

    A value's place is its file line and the column in that line. A chunk is trimmed, so its first line lacks the
    indentation: places are compared by ``column``, from the line's first character that is not blank. ``start`` and
    ``end`` count from the beginning of the file line, with the ``indent`` that a chunk shows which holds the line further
    down; where none does, ``indent`` is null and they count as ``column`` does. ``end`` may lie beyond the line's end (a
    key block): it is ``start`` and the value's ``length``. Of a value that a chunk's end cuts off, the longest part counts.

    Without a file path or ``line_start`` a place in the file is unknown: the values of such a chunk keep its
    ``chunk_id``, and ``chunk_line`` counts from 0 within it; both are null for all others.
    """
    s = credential_spans(chunks, "id", "content", "line_start", "file_path")
    known = F.col("key").isNotNull() & F.col("first_line").isNotNull()
    places = s.select(
        F.col("key").alias("file_path"), (F.col("first_line") + F.col("line_no")).alias("line_no"),
        F.when(~known, F.col("record_id")).alias("chunk_id"), F.when(~known, F.col("line_no")).alias("chunk_line"), "column",
        F.struct((F.col("end") - F.col("start")).alias("length"), "kind").alias("value"), F.when(F.col("line_no") > 0, F.col("indent")).alias("indent"),
    )
    v = places.groupBy("file_path", "line_no", "chunk_id", "chunk_line", "column").agg(F.max("value").alias("value"), F.max("indent").alias("indent"))
    start = F.col("column") + F.coalesce("indent", F.lit(0))
    return v.select("file_path", "line_no", "chunk_id", "chunk_line", "column", "indent", start.alias("start"), (start + F.col("value.length")).alias("end"), "value.length", "value.kind")
