"""Secrets: fixed expressions, and two character Markov models compared by log-likelihood ratio.

One second-order model is trained on random strings, the other on ordinary
identifiers (both labelled samples, see ``samples``). A token of at least
``SHORTEST`` characters is added when the mean log2-likelihood ratio per
character reaches ``RATIO``, unless it overlaps a base span or is not ``mixed``: without a digit
and with fewer than three changes of case a token is taken for words, whatever the ratio. On
samples of another seed, RATIO passes under 1 % of the identifiers and over 98 % of the random
strings. Runs of one character or of the alphabet are ordinary; a UUID is a random string.

A text takes time in proportion to its length. Defined results: null and empty texts
have no spans; a very long text is searched whole; repeated rows each get their
row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .spans import Span, Taken, replaced, span_rows

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "random"]
SHORTEST = 20
RATIO = 0.5
MARK = "[SECRET]"
#: Labelled random strings that the model is trained on.
SAMPLE = 3000
#: Words that the labelled identifiers are put together from.
WORDS = (
    "abstract action address align alpha apply argument assert attribute author backup batch bit body border build bytes call catch channel check "
    "class cluster collection column comment common component connection container context convert core create data date default dependency "
    "detail dictionary document driver email encoding entity environment event exception expression factory field filter folder frame general "
    "graph handler header history html import info input integer internal iterator kernel label layer length library line list location manager "
    "master memory message metric model monitor network number offset order package parameter parse path payload plugin policy price print "
    "product project protocol proxy queue range record register remote resource result role route rule sample scope search section select server "
    "session shape signal size split start static storage string style symbol table task text time token top trace transaction tree type update "
    "url utility variable version visible web width word wrapper"
)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def samples(n: int = SAMPLE, seed: int = 20) -> tuple[list[str], list[str]]:
    """Labelled samples: n random strings of several alphabets; identifiers put together from ``WORDS`` in the usual spellings, and plain runs."""
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [digits + "abcdef", upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "_-", upper + digits, lower + digits, upper + lower]
    random_strings = ["".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randint(20, 64))) for i in range(n)]
    words = WORDS.split()
    some = lambda: [rng.choice(words) for _ in range(rng.randint(2, 6))]
    number = lambda: rng.choice(["", "", str(rng.randint(0, 99)), str(rng.randint(1990, 2030))])
    spelt = [
        lambda: "_".join(some()) + number(), lambda: "-".join(some()) + number(), lambda: "/".join(some()), lambda: "".join(some()),
        lambda: "_".join(some()).upper(), lambda: "".join(w.title() for w in some()) + number(), lambda: "".join(w.title() for w in some()).swapcase()[:1].lower() + "".join(w.title() for w in some()),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-" + "-".join(some()),
    ]
    identifiers = [spelt[i % len(spelt)]() for i in range(2 * n)]
    runs = [c * rng.randint(20, 40) for c in upper + lower + digits + "=-_"] + [(x * 3)[i : i + rng.randint(20, 30)] for x in (upper, lower, digits) for i in range(len(x))]
    return random_strings, words + identifiers + runs


def mixed(token: str) -> bool:
    """Whether a token holds a digit, or its letters change case three times or more: long plain words of any language do neither."""
    case = [c.isupper() for c in token if c.isalpha()]
    return any(c.isdigit() for c in token) or sum(x != y for x, y in zip(case, case[1:], strict=False)) >= 3


class Markov:
    """Second-order character model with additive back-off; characters are classed over a fixed alphabet."""

    ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."

    def __init__(self, texts: list[str]) -> None:
        self.three: dict[str, int] = {}
        self.two: dict[str, int] = {}
        self.one: dict[str, int] = {}
        for t in texts:
            t = "^^" + t
            for i in range(2, len(t)):
                for table, n in ((self.three, 2), (self.two, 1), (self.one, 0)):
                    table[t[i - n : i + 1]] = table.get(t[i - n : i + 1], 0) + 1
                    table[t[i - n : i] + "\0"] = table.get(t[i - n : i] + "\0", 0) + 1
        self.memo: dict[str, float] = {}

    def logp(self, gram: str) -> float:
        """log2 p of the third character after the first two."""
        if (x := self.memo.get(gram)) is None:
            size = len(self.ALPHABET)
            p = (self.one.get(gram[2], 0) + 1) / (self.one["\0"] + size)
            p = (self.two.get(gram[1:], 0) + 8 * p) / (self.two.get(gram[1] + "\0", 0) + 8)
            p = (self.three.get(gram, 0) + 8 * p) / (self.three.get(gram[:2] + "\0", 0) + 8)
            x = self.memo[gram] = math.log2(p)
        return x


@lru_cache(maxsize=1)
def models() -> tuple[Markov, Markov]:
    random_strings, ordinary = samples()
    return Markov(random_strings), Markov(ordinary)


def ratio(token: str) -> float:
    """Mean log2-likelihood ratio of random over ordinary, per character."""
    odd, usual = models()
    t = "^^" + token
    return sum(odd.logp(t[i : i + 3]) - usual.logp(t[i : i + 3]) for i in range(len(token))) / len(token)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if _HINT.search(text):
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the random tokens beside them."""
    base = base_spans(text)
    taken = Taken(base)
    more = [("random", *m.span()) for m in _TOKEN.finditer(text) if not taken.meets(*m.span()) and mixed(m[0]) and ratio(m[0]) >= RATIO]
    return base, more


def secrets(docs: DataFrame) -> DataFrame:
    return span_rows(docs, find, KINDS, BASE)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by ``MARK``."""
    return replaced(docs, find, MARK)
