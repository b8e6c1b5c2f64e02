"""Operator 10: secret scans with a guess-cost dynamic program over values in a credential context.

Three patterns give the base spans. The method adds those values that follow a credential word and would cost an
attacker many guesses: the value is cut into words, dates, repeats, keyboard walks and brute-force spans so that the
total cost, log10 of the guesses, is the least of all segmentations. Placeholders and plain words cost little. Words are
those of a short list of frequent passwords, then the whole words of a tokenizer's vocabulary, whose order is that of
their merges: the sooner merged, the more frequent.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from flowlark.llm import bpe
from flowlark.llm.common import arrow_rows, documents

# The patterns of the contract. Letters outside the second group of assign are in either case.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: A credential word, a separator and a value of visible characters, quoted or not. Wider than assign: other words,
#: other separators, and values with any symbol.
CONTEXT = re.compile(
    r"""(?ai:(?<![a-z])(password|passwd|passphrase|passcode|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|auth|bearer)s?)"""
    r"""(?:["']?[ \t]*(?:=>|:=|[:=])[ \t]*|[ \t]+(?ai:is)[ \t]+)["']?([^\s"']+)"""
)
_HINT = re.compile(r"(?ai:pass|pwd|secret|token|key|credential|auth|bearer)")

# Frequent passwords and words, most frequent first, and the rows of a keyboard.
WORDS = (
    "password pass secret admin user token key test example letmein welcome login master default changeme root guest "
    "qwerty dragon monkey sunshine princess football baseball shadow superman michael iloveyou trustno1 hello summer "
    "winter spring autumn love god money freedom computer internet server database system private public access "
    "account your here value string none null true false todo xxx placeholder redacted dummy sample demo temp foo bar "
    "the and for with this that from have not are was you all any can her one our out day get has him his how man new "
    "now old see two way who boy did its let put say she too use api auth bearer client basic dev prod staging local"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")


@dataclass(frozen=True)
class Lexicon:
    """Ranks of words, 1 for the most frequent, and the length of the longest."""

    rank: dict[str, int]
    longest: int

    @classmethod
    def of(cls, words: list[str]) -> Lexicon:
        rank: dict[str, int] = {}
        for w in words:
            rank.setdefault(w, len(rank) + 1)
        return cls(rank, max(map(len, rank)))

    @classmethod
    def of_vocabulary(cls, content: bytes) -> Lexicon:
        """The short list, then the words (three small letters or more) that a byte-level BPE vocabulary has whole: a
        token that starts with a blank is the beginning of a word in running text, and a frequent word is such a token."""
        ids = json.loads(content)["model"]["vocab"]
        whole = (t[1:].lower() for t in sorted(ids, key=ids.__getitem__) if t[0] == "\u0120" and len(t) > 3 and t[1:].isascii() and t[1:].isalpha())
        return cls.of([*WORDS, *whole])


_SHORT = Lexicon.of(WORDS)
_LEET = str.maketrans("4@3105$7", "aaeiosst")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def _neighbours() -> set[tuple[str, str]]:
    out = set()
    for y, row in enumerate(KEYBOARD):
        for x, c in enumerate(row):
            for dy, dx in ((0, 1), (1, -1), (1, 0)):
                if 0 <= y + dy < len(KEYBOARD) and 0 <= x + dx < len(KEYBOARD[y + dy]):
                    out |= {(c, KEYBOARD[y + dy][x + dx]), (KEYBOARD[y + dy][x + dx], c)}
    return out


_NEAR = _neighbours()


#: The cheapest character of a brute-force span, and what a further segment costs: log10 of the guesses.
_CHEAPEST, _JOIN = math.log10(8), math.log10(2)


def guess_cost(value: str, lexicon: Lexicon = _SHORT, enough: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs, and its segments (kind, start, end); once
    no segmentation can stay below ``enough``, infinity and none.

    A word costs its rank (twice that for each change of case or look-alike character), a date the days of 200 years, a
    repeat (three characters or more) its unit's characters and their count, a walk along the keyboard its start, length and
    turns, and a brute-force span the size of each character's class (less for a small letter after a letter). Each further
    segment doubles the guesses.

    Units are of any length: one whose characters cost ``enough`` already cannot be part of a cheaper segmentation, which bounds
    what has to be looked at. Of the repeats (or walks) that may go on at a place, one that is not the cheapest when it
    is first complete never will be, as the counts of two draw nearer; it is dropped. So time is linear in the length, but for infinite ``enough``.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters change their length in lower case
        low = value
    plain = low.translate(_LEET)
    chars = [_char(value, i) for i in range(n)] if n <= 64 else None
    widest = n // 2 if enough == math.inf else min(n // 2, int(enough / _CHEAPEST))
    best = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute, brute_from = math.inf, 0  # cheapest way to the present place that ends in a brute-force span
    last = 0  # the last place that a segmentation below ``enough`` may pass
    upto = [0.0]  # cost of the characters before each place
    equal = [0] * (widest + 1)  # characters before the present place that equal the ones so far before them
    repeats: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(widest + 1)]  # by unit and place modulo the unit: those that go on
    walks: list[tuple[int, float]] = []
    walk = 0  # where the present walk began
    turns: list[int] = []  # up to each character
    for j in range(n + 1):
        if j:
            x = j - 1
            for u in range(1, min(widest, x) + 1):
                if value[x] != value[x - u]:
                    if equal[u]:
                        equal[u] = 0
                        repeats[u].clear()
                    continue
                equal[u] += 1
                held = repeats[u].setdefault(j % u, [])
                if equal[u] >= u and (s := j - 2 * u) >= 0 and 2 * u >= 3 and best[s] < enough:
                    _offer(held, s, best[s] + (_JOIN if s else 0.0) + upto[s + u] - upto[s], lambda s: math.log10((j - s) / u))  # noqa: B023
                elif u == 1 and equal[1] >= 2 and best[j - 3] < enough:
                    _offer(held, j - 3, best[j - 3] + (_JOIN if j > 3 else 0.0) + upto[j - 2] - upto[j - 3], lambda s: math.log10(j - s))  # noqa: B023
                for s, cost in held:
                    if (cost := cost + math.log10((j - s) / u)) < best[j]:
                        best[j], back[j] = cost, ("repeat", s)
            near = x > 0 and _adjacent(low[x - 1], low[x])
            turns.append((turns[-1] if turns else 0) + (near and walk < x - 1 and ord(low[x]) - ord(low[x - 1]) != ord(low[x - 1]) - ord(low[x - 2])))
            if not near:
                walk = x
                walks.clear()
            elif (s := j - 3) >= walk and best[s] < enough:
                _offer(walks, s, best[s] + (_JOIN if s else 0.0) + math.log10(47) - 0.15 * turns[s + 1], lambda s: math.log10(j - s))  # noqa: B023
            for s, cost in walks:
                if (cost := cost + math.log10(j - s) + 0.15 * turns[x]) < best[j]:
                    best[j], back[j] = cost, ("walk", s)
        if best[j] < enough:
            last = max(last, min(n, j + max(1, 2 * widest, 3)))
        if j > last:
            return math.inf, []
        if j == n:
            break
        if best[j] < enough:
            start = best[j] + (_JOIN if j else 0.0)
            for kind, end, cost in _words_and_dates(value, low, plain, lexicon, j):
                if start + cost < best[end]:
                    best[end], back[end] = start + cost, (kind, j)
                    if best[end] < enough:
                        last = max(last, end)
            if start < brute:
                brute, brute_from = start, j
        c = chars[j] if chars else _char(value, j)
        upto.append(upto[-1] + c)
        brute += c
        if brute < best[j + 1]:
            best[j + 1], back[j + 1] = brute, ("brute", brute_from)
    if best[n] >= enough:
        return math.inf, []
    cuts, at = [], n
    while at:
        kind, start = back[at]
        cuts.append((kind, start, at))
        at = start
    return best[n], cuts[::-1]


def _offer(held: list[tuple[int, float]], start: int, cost: float, more) -> None:
    """Adds a start to those that go on, unless one of them is as cheap already; drops those that never will be cheaper."""
    now = cost + more(start)
    if all(c + more(s) > now for s, c in held):
        held[:] = [(s, c) for s, c in held if c < cost]
        held.append((start, cost))


def _char(value: str, i: int) -> float:
    """log10 of the size of a character's class; a small letter after a letter is half known in any language."""
    c = value[i]
    if i and c.islower() and c.isalpha() and value[i - 1].isalpha():
        return _CHEAPEST
    return math.log10(10 if c.isdigit() else 26 if c.islower() else 30 if c.isupper() else 60)


def _adjacent(a: str, b: str) -> bool:
    """Keys next to each other, or characters next to each other in their alphabet."""
    return (a, b) in _NEAR or abs(ord(a) - ord(b)) == 1


def _words_and_dates(value: str, low: str, plain: str, lexicon: Lexicon, i: int):
    """(kind, end, log10 of guesses) of each that starts at a place."""
    rank, n = lexicon.rank, len(value)
    for j in range(i + 2, min(n, i + lexicon.longest) + 1):
        for text in {low[i:j], plain[i:j]}:
            if text in rank:
                changes = sum(x != y for x, y in zip(value[i:j], text, strict=True))
                yield "word", j, math.log10(rank[text]) + _JOIN * min(changes, 4)
    if low[i].isdigit():
        for j in range(i + 4, min(n, i + 10) + 1):
            if _DATE.fullmatch(low, i, j):
                yield "date", j, math.log10(365 * 200)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns' matches that are long enough."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str | None, hard: float = 10.0, lexicon: Lexicon = _SHORT) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, by start and kind. A value, however long, counts as a secret if its cheapest
    segmentation costs 10^``hard`` guesses or more."""
    text = text or ""
    if not text:
        return [], []
    base = base_spans(text)
    more = []
    if _HINT.search(text):
        for m in CONTEXT.finditer(text):
            value = m[2].rstrip(",;)]}>.")
            if len(value) >= 6 and guess_cost(value, lexicon, hard)[0] >= hard:
                span = m.start(2), m.start(2) + len(value)
                if not any(a <= span[0] and span[1] <= z for a, _, z in base):
                    more.append((span[0], 3, span[1]))
    return base, sorted(base + more)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


_lexicons: dict[int, Lexicon] = {}


def _shared_lexicon(df: DataFrame, vocabulary: str | None):
    """A function that gives a task its lexicon; the vocabulary's file, of fixed size, is broadcast."""
    if vocabulary is None:
        return lambda: _SHORT
    shared = bpe.share(df.sparkSession, vocabulary)

    def lexicon() -> Lexicon:
        name = hash(shared.value)
        if name not in _lexicons:
            _lexicons[name] = Lexicon.of_vocabulary(shared.value)
        return _lexicons[name]

    return lexicon


def find_secrets(df: DataFrame, hard: float = 10.0, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, one row for each row of ``df``.

    Spans are kind:start:end in code points, end exclusive, by start and then kind (assign, access, hex, guess).
    Guess spans are the values alone, and only those outside the base spans. ``vocabulary`` is the path of a byte-level
    BPE vocabulary whose words count as words; without it only a short list does. Null texts are empty and have no spans.
    Nothing is shuffled; repeated rows, null doc_ids and empty tables stay as they are, extra columns are ignored.
    """

    lexicon = _shared_lexicon(df, vocabulary)

    def work(batches):
        words = lexicon()
        for b in arrow_rows(batches):
            out = []
            for t in b.column(1):
                base, every = scan(t.as_py(), hard, words)
                count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((*count, hashlib.sha256(_named(base).encode()).hexdigest(), _named(every)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = zip(*out, strict=True)
            yield pa.record_batch(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    return documents(df, id_col=id_col, text_col=text_col).mapInArrow(work, FOUND)


def masked(text: str | None, mark: str = "[SECRET]", hard: float = 10.0, lexicon: Lexicon = _SHORT) -> str | None:
    """The text with ``mark`` for each run of spans; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, _, z in scan(text, hard, lexicon)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", hard: float = 10.0, vocabulary: str | None = None) -> DataFrame:
    """``df`` with every secret in its text replaced by ``mark``; all columns stay, null texts too."""
    from pyspark.sql import functions as F

    lexicon = _shared_lexicon(df, vocabulary)

    @F.pandas_udf("string")
    def mask(texts):
        words = lexicon()
        return texts.map(lambda t: masked(t, mark, hard, words), na_action="ignore")

    return df.withColumn(text_col, mask(F.col(text_col)))
