"""Secret scans: fixed patterns, and formats learned by grammar inference.

Base patterns give spans of kinds ``assign``, ``access`` and ``hex``. The learned part
builds a prefix tree of labelled credentials, merges its statistically compatible states
(red-blue state merging with a Hoeffding test) into a probabilistic automaton, and scores
every candidate token of a text by its likelihood under that automaton; accepted tokens
that no base span covers become spans of kind ``format``. Candidates are the parts of a
run of token characters outside base spans and the sub-runs within them, of ``LEAST``
characters and more.

``learn`` takes the corpus's own labelled credentials (the values of base spans) beside drawn
examples of public formats, learns a second automaton from plain tokens of the corpus, and
sets the least margin between both from plain tokens of the corpus that the automaton has not
seen. All distinct tokens are counted, by Spark; none is drawn.
"""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_written, text_bytes, written

KINDS = ("assign", "access", "hex", "format")
#: Fixed patterns of the contract, over bytes: letters of any other script never match.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a match of [0-9a-f]+ of 24 or more characters
#: Fewer characters are no candidate; marks that labelled credentials do not hold part sub-runs.
LEAST = 16
INNER = re.compile(rb"[A-Za-z0-9_-]{16,}")
RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")


def _marks(chars: bytes) -> bytes:
    return bytes(1 if c in chars else 0 for c in range(256))


_HEX_CHARS = b"0123456789abcdef"
_TOKEN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_IS_HEX, _IS_TOKEN = _marks(_HEX_CHARS), _marks(_TOKEN_CHARS)


# ---------------------------------------------------------------- labelled credentials
def labelled_credentials(each: int = 60, seed: int = 42) -> list[str]:
    """Examples of public credential formats, drawn from their descriptions."""
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    draw = lambda chars, n: "".join(rng.choices(chars, k=n))
    out = []
    for _ in range(each):
        out += [
            "AKIA" + draw(upper + digits, 16),
            "ghp_" + draw(upper + lower + digits, 36),
            "xoxb-" + draw(digits, 12) + "-" + draw(digits, 12) + "-" + draw(upper + lower + digits, 24),
            "AIza" + draw(upper + lower + digits + "_-", 35),
            "sk_live_" + draw(upper + lower + digits, 24),
            draw(_HEX_CHARS.decode(), 40),
            draw(_HEX_CHARS.decode(), 64),
        ]
    return out


def labelled_ids(each: int = 80, seed: int = 44) -> list[str]:
    """Examples of ordinary identifiers: UUIDs, trace ids, short digests, groups of digits."""
    rng = random.Random(seed)
    draw = lambda n, chars="0123456789abcdef": "".join(rng.choices(chars, k=n))
    out = []
    for _ in range(each):
        uuid = f"{draw(8)}-{draw(4)}-4{draw(3)}-{draw(1, '89ab')}{draw(3)}-{draw(12)}"
        out += [uuid, uuid.upper(), draw(16), draw(rng.randint(16, 23)), draw(16).upper(), "-".join(draw(4) for _ in range(rng.randint(4, 6))), "-".join(draw(8) for _ in range(rng.randint(2, 4))), "-".join(draw(4, "0123456789") for _ in range(4))]
    return out


def labelled_plain(each: int = 80, seed: int = 43) -> list[str]:
    """Examples of long tokens that are no credentials: numbers, words, names of files."""
    rng = random.Random(seed)
    syllable = lambda: rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice("nrst" + " " * 4).strip()
    word = lambda n: "".join(syllable() for _ in range(n))
    out = []
    for _ in range(each):
        out += [
            "".join(rng.choices("0123456789", k=rng.randint(12, 24))),
            word(rng.randint(6, 10)),
            rng.choice("-_./").join(word(rng.randint(1, 3)) for _ in range(rng.randint(3, 6))),
            ".".join(word(2) for _ in range(3)),
            "-".join("".join(rng.choices("0123456789", k=4)) for _ in range(4)),
        ]
    return out


# ---------------------------------------------------------------- grammar inference
def _kind(c: str) -> str:
    return "digit" if c.isdigit() else "capital" if c.isupper() else "a-f" if c in "abcdef" else "g-z" if c.isalpha() else "mark"


#: A state with less weight than this is too rare to be told from others.
FEW = 4
#: Lengths of prefixes that are counted together; longer tokens teach nothing.
DEPTHS = (0, 4, 12, 128)


def _after(state: str, c: str, often: set[str]) -> str:
    """The state after one more character. A state is ``=`` and a prefix if that is ``often``
    met; the rare ones are merged beforehand by their length and their last kind of character."""
    if state[0] == "=" and state + c in often:
        return state + c
    depth = len(state) if state[0] == "=" else int(state[1:].partition(" ")[0]) + 1
    return f"~{depth} {_kind(c)}"


def _steps(words: Iterable[str], often: set[str]) -> Counter:
    """(state, character) -> how many words pass there; the character is empty at their ends."""
    out: Counter = Counter()
    for w in words:
        s = "="
        for c in w:
            out[s, c] += 1
            s = _after(s, c, often)
        out[s, ""] += 1
    return out


def _prefixes(words: Iterable[str]) -> set[str]:
    return {"=" + w[:k] for w in words for k in range(len(w) + 1)}


class Automaton:
    """Probabilistic automaton: per state, counts and targets by character, and ends. ``steps``
    and ``often`` are those of ``_steps``; steps may have weights."""

    def __init__(self, steps: dict[tuple[str, str], float], often: set[str], alpha: float = 0.02):
        out: dict[str, dict[str, float]] = {}
        for (s, c), n in steps.items():
            out.setdefault(s, {})[c] = n
        self.next: list[dict[str, int]] = []
        self.count: list[dict[str, float]] = []
        self.ends: list[float] = []
        names, at = ["="], {"=": 0}
        for s in names:  # grows
            then = {}
            for c in sorted(out.get(s, {}).keys() - {""}):
                to = _after(s, c, often)
                if to not in at:
                    at[to] = len(names)
                    names.append(to)
                then[c] = at[to]
            self.next.append(then)
            self.count.append({c: out[s][c] for c in then})
            self.ends.append(out.get(s, {}).get("", 0))
        self._alias = list(range(len(names)))
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        del self._alias
        self.total = [sum(c.values()) + e for c, e in zip(self.count, self.ends, strict=True)]

    def _now(self, s: int) -> int:
        """The state that took in ``s``."""
        while self._alias[s] != s:
            self._alias[s] = s = self._alias[self._alias[s]]
        return s

    def _total(self, s: int) -> int:
        return sum(self.count[s].values()) + self.ends[s]

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _kinds(self, s: int) -> dict[str, int]:
        """Counts by kind of character: single ones of a large alphabet are too rare to tell."""
        out: dict[str, int] = {}
        for c, n in self.count[s].items():
            out[_kind(c)] = out.get(_kind(c), 0) + n
        return out

    def _distance(self, a: int, b: int) -> float:
        x, y, n, m = self._kinds(a), self._kinds(b), max(1, self._total(a)), max(1, self._total(b))
        return sum(abs(x.get(k, 0) / n - y.get(k, 0) / m) for k in sorted(x.keys() | y.keys())) + abs(self.ends[a] / n - self.ends[b] / m)

    def _compatible(self, red: int, blue: int) -> bool:
        todo, seen = [(red, blue)], set()
        while todo:
            a, b = map(self._now, todo.pop())
            n, m = self._total(a), self._total(b)
            if a == b or (a, b) in seen or n < FEW or m < FEW:
                continue  # too few to tell
            seen.add((a, b))
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            x, y = self._kinds(a), self._kinds(b)
            if any(self._differ(x.get(k, 0), n, y.get(k, 0), m) for k in x.keys() | y.keys()):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int, depth: dict[int, int]) -> None:
        """States that the same characters lead to become one; of two the red one stays."""
        todo = [(red, blue)]
        while todo:
            a, b = map(self._now, todo.pop())
            if a == b:
                continue
            if a not in depth and b in depth:
                a, b = b, a
            self._alias[b] = a
            depth.pop(b, None)
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        depth = {0: 0}
        while True:
            blue = next(((s, t) for s in depth for _, u in sorted(self.next[s].items()) if (t := self._now(u)) not in depth), None)
            if not blue:
                break
            s, t = blue
            # Of the compatible states the most similar one; the start never takes others in.
            near = sorted((d, r) for r in depth if r and (d := self._distance(r, t)) <= 0.4 + 2 / math.sqrt(max(1, self._total(t))))
            r = next((r for _, r in near if self._compatible(r, t)), None)
            if r is not None:
                self._fold(r, t, depth)
            else:
                depth[t] = depth[s] + 1
        at = {s: i for i, s in enumerate(depth)}
        self.next, self.count, self.ends = (
            [{c: at[self._now(t)] for c, t in self.next[s].items()} for s in depth],
            [self.count[s] for s in depth],
            [self.ends[s] for s in depth],
        )

    def means(self, word: str) -> Iterator[float]:
        """Mean log probability of a character for every beginning of the word, as far as
        the format has a way on."""
        s, total = 0, 0.0
        for i, c in enumerate(word, 1):
            n = self.count[s].get(c, 0)
            if not n:  # a character not seen here goes the way of its kind, if several have been seen
                kind = [(m, d) for d, m in self.count[s].items() if _kind(d) == _kind(c)]
                if len(kind) < 3:
                    return
                c = max(kind)[1]
            total += math.log((n or 0.5) / self.total[s])
            s = self.next[s][c]
            yield total / i if self.total[s] else -math.inf

    def likelihood(self, word: str) -> float:
        """Mean log probability of a character; -inf where the format has no way on."""
        found = list(self.means(word))
        return -math.inf if len(found) < len(word) else found[-1] if word else 0.0


    def smoothed(self, word: str, floor: float = math.log(1 / 256)) -> float:
        """As ``likelihood``, but a character without a way on costs ``floor`` and the rest of
        the word starts anew."""
        total, at = 0.0, 0
        while at < len(word):
            found = list(self.means(word[at:]))
            total += (found[-1] * len(found) if found and found[-1] > -math.inf else floor * len(found)) + floor * (at + len(found) < len(word))
            at += len(found) + 1
        return total / max(1, len(word))


class Format:
    """One format: what all its credentials begin with, an automaton of the rest, how long they
    are, and the least likelihood of one (``cut``). States of different beginnings are never
    merged, and a length that no labelled credential has costs as much as one among a million."""

    def __init__(self, prefix: str, automaton: Automaton, lengths: dict[int, float]):
        self.prefix, self.automaton, self.cut = prefix, automaton, math.inf
        self.lengths, self.words = lengths, sum(lengths.values())

    def cut_at(self, scores: dict[float, int], quantile: float) -> None:
        """scores: how many credentials have each likelihood."""
        kept = sorted((x, n) for x, n in scores.items() if x > -math.inf)
        if kept:
            x, n = (np.array(k, float) for k in zip(*kept, strict=True))
            least = x[np.searchsorted(np.cumsum(n), int(quantile * n.sum()), "right")]
            # Three deviations lower, as the characters of few examples are not evenly frequent.
            self.cut = float(least - 3 * math.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)))

    def means(self, word: str) -> Iterator[float]:
        """As those of an automaton; the characters of the beginning are sure."""
        n = len(self.prefix)
        if word.startswith(self.prefix):
            yield from [0.0] * n
            yield from (m * i / (n + i) for i, m in enumerate(self.automaton.means(word[n:]), 1))

    def of_length(self, n: int) -> float:
        return math.log(max(self.lengths.get(n, 0), 1e-6 * self.words) / self.words) / n

    def likelihood(self, word: str) -> float:
        """Mean log probability of a character, the length included; -inf without a way on."""
        found = list(self.means(word))
        return found[-1] + self.of_length(len(word)) if word and len(found) == len(word) else -math.inf


class Labelled:
    """What tokens teach: for each group (fixed beginnings of credentials, ``""`` for those
    without one) how many begin so, what all begin with, their lengths and steps; for plain
    tokens the steps of each half. Weights are numbers of tokens, or shares of them."""

    def __init__(self, words: list[str], plain: list[str]):
        self.words, self.plain = words, plain
        self.heads, self.total = Counter(w[:4] for w in words), len(words)
        self.ends: dict[str, list[str]] = {}  # by head, tokens between which all others stand
        self.lengths: dict[str, Counter] = {}
        self.steps: dict[str, Counter] = {}
        self.often: dict[str, set[str]] = {"-": _prefixes(plain)}
        for w in words:
            self.ends.setdefault(w[:4], []).append(w)

    def group(self) -> None:
        """Settles the groups, once ``heads`` and ``ends`` are complete, and adds the drawn words."""
        #: Fixed beginnings of formats: only these tell where a glued credential starts.
        self.fixed = {h for h, n in self.heads.items() if n >= max(3, 0.02 * self.total)}
        self.prefix = {h: os.path.commonprefix(self.ends[h]) for h in self.fixed} | {"": ""}
        for h, prefix in self.prefix.items():
            mine = [w for w in self.words if self.head(w) == h]
            self.often[h] = _prefixes(w[len(prefix) :] for w in mine)
            self.steps[h] = _steps((w[len(prefix) :] for w in mine), self.often[h])
            self.lengths[h] = Counter(map(len, mine))

    def head(self, word: str) -> str:
        return word[:4] if word[:4] in self.fixed else ""


class Model:
    """Formats of credentials, by their fixed beginning (``""``: those without one), and an
    automaton of plain tokens. A token is accepted if its likelihood as a credential reaches the
    lowest ``quantile`` of fresh labelled ones of its format (random parts vary) and exceeds its
    likelihood as a plain token by ``margin``."""

    def __init__(self, known: Labelled | None = None, held: list[str] | None = None, quantile: float = 0.002, alpha: float = 0.02, margin: float = 0.0):
        held = held or labelled_credentials(100, seed=7)
        if known is None:
            known = Labelled(labelled_credentials(), labelled_plain() + labelled_ids())
            known.group()
        plain = _steps(known.plain, known.often["-"])
        halves = [known.steps[k] for k in ("-0", "-1") if k in known.steps]
        self.plain = Automaton(_sum(plain, *halves), known.often["-"], alpha)
        #: Automata of plain tokens that have not seen the first, the second half of the corpus.
        self.others = [Automaton(_sum(plain, h, h), known.often["-"], alpha) for h in reversed(halves)]
        #: A sub-run longer than this is no credential of a labelled format.
        self.longest = 2 * max(n for lengths in known.lengths.values() for n in lengths)
        self.heads, self.margin, self.quantile = known.fixed, margin, quantile
        self.formats: dict[str, Format] = {}
        for h in sorted(known.prefix):
            if known.lengths[h]:
                self.formats[h] = Format(known.prefix[h], Automaton(known.steps[h], known.often[h], alpha), known.lengths[h])
                self.formats[h].cut_at(Counter(self.formats[h].likelihood(w) for w in held if self._head(w) == h), quantile)

    def _head(self, word: str) -> str:
        return word[:4] if word[:4] in self.heads else ""

    def format_of(self, word: str) -> Format | None:
        return self.formats.get(self._head(word))

    def over(self, word: str, plain: Automaton | None = None) -> float:
        """How much likelier a character of the word is as one of a credential."""
        f = self.format_of(word)
        s = f.likelihood(word) if f else -math.inf
        return s - (plain or self.plain).smoothed(word) if f and s >= f.cut else -math.inf

    def accepts(self, word: str) -> bool:
        return self.over(word) > self.margin


def _sum(*steps: Counter) -> Counter:
    out: Counter = Counter()
    for one in steps:
        out.update(one)
    return out


# ---------------------------------------------------------------- spans
def _formats(run: bytes, model: Model) -> list[tuple[int, int]]:
    """Accepted candidates of a run: the whole run, or else the sub-runs between marks, or
    else, within those, from the start of any word and from any beginning of a format (text
    may be glued to it) the longest part up to an end of the sub-run or of a word in it."""
    if len(run) < LEAST:
        return []
    if model.accepts(run.decode("ascii")):
        return [(0, len(run))]
    return [(m.start() + s, m.start() + e) for m in INNER.finditer(run) for s, e in _inner(m.group().decode("ascii"), model)]


def _inner(word: str, model: Model) -> Iterator[tuple[int, int]]:
    at, n = 0, len(word)
    while at <= n - LEAST:
        if at and word[at - 1] not in "_-" and word[at : at + 4] not in model.heads:
            at += 1
            continue
        known = model.format_of(word[at : at + 4])
        means = list(known.means(word[at : at + model.longest])) if known else []
        ends = (e for e in range(at + len(means), at + LEAST - 1, -1) if (e == n or word[e] in "_-") and means[e - at - 1] + known.of_length(e - at) >= known.cut)
        end = next((e for e in ends if model.accepts(word[at:e])), None)
        if end:
            yield at, end
        at = end or at + 1


def spans(text: bytes, model: Model | None, bytes_: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind; with ``bytes_`` in bytes and
    with the number of the kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\1" * 24 in text.translate(_IS_HEX):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if model is not None:
        shape, base = text.translate(_IS_TOKEN), sorted(found)
        at = shape.find(b"\1" * 16)
        while at >= 0:
            end = shape.find(b"\0", at)
            end = len(text) if end < 0 else end
            lo = at
            for s, e in [*((s, e) for s, e, _ in base if s < end and at < e), (end, end)]:
                found += [(lo + a, lo + b, 3) for a, b in _formats(text[lo:s], model)]
                lo = max(lo, e)
            at = shape.find(b"\1" * 16, end)
    if not found:
        return []
    found.sort(key=lambda x: (x[0], x[2]))
    if bytes_:
        return found
    if not text.isascii():
        # code points before each byte: all bytes but the continuation bytes
        before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        found = [(int(before[s]), int(before[e]), k) for s, e, k in found]
    return [(s, e, KINDS[k]) for s, e, k in found]


def learn(docs: DataFrame, text_col: str = "text", weight: int = 300) -> Model:
    """A model of the corpus, from all distinct tokens of up to 128 characters (longer ones teach
    nothing) of all its texts: values of base spans are labelled credentials, others plain tokens.

    Only counts reach the driver: beginnings, lengths, and the steps of the tokens through a
    prefix tree whose rare states are merged (``_after``); all labelled and all plain tokens weigh
    as much as ``weight`` ones beside the drawn examples, if they are more. A format that no drawn
    example has takes its cut from all its tokens. At most one in a thousand of all plain tokens
    exceeds the margin, each judged by an automaton of the other half of them, and of fresh drawn
    identifiers. An empty table gives the model of the drawn examples."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            found = set()
            for text in b.column(0).to_pylist():
                base = spans(text, None, bytes_=True)
                for s, e, k in base:
                    m = ASSIGN.match(text, s, e) if k == 0 else None
                    found.add((True, (m.group(2) if m else text[s:e]).decode("ascii")))
                if b"\1" * LEAST in text.translate(_IS_TOKEN):
                    found |= {(False, m.group().decode("ascii")) for m in RUN.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in base)}
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string())], names=["label", "token"])

    tokens = docs.select(text_bytes(text_col).alias("_text")).mapInArrow(of, "label boolean, token string").where(F.length("token") <= DEPTHS[-1]).distinct()
    tokens = written(tokens, "tokens")
    known = Labelled(labelled_credentials(), labelled_plain() + labelled_ids())
    number = {r[0]: r[1] for r in tokens.groupBy("label").count().collect()}
    share = {k: weight / max(weight, n) for k, n in number.items()}
    head = F.substring("token", 1, 4).alias("head")
    begin = tokens.where("label").groupBy(head).agg(F.count("*").alias("n"), F.min("token").alias("a"), F.max("token").alias("z"))
    for r in begin.where((F.col("n") * share.get(True, 1) >= 1) | F.col("head").isin(list(known.heads))).collect():
        known.heads[r["head"]] += r["n"] * share[True]
        known.ends.setdefault(r["head"], []).extend((r["a"], r["z"]))
    known.total += number.get(True, 0) * share.get(True, 1)
    known.group()
    fixed = F.substring("token", 1, 4).isin(list(known.fixed))
    g = F.when(~F.col("label"), "-").when(fixed, F.substring("token", 1, 4)).otherwise("").alias("g")
    lead = F.coalesce(*[F.when(F.col("g") == h, len(p)) for h, p in known.prefix.items()], F.lit(0))
    half = F.pmod(F.xxhash64("token", F.lit(12)), F.lit(2)).cast("int").alias("half")
    rows = tokens.select("label", "token", g, half).withColumn("rest", F.substr("token", lead + 1))
    few = FEW / F.when(F.col("g") == "-", share.get(False, 1)).otherwise(share.get(True, 1))
    longer = rows.select("g", "rest")
    for a, b in zip(DEPTHS, DEPTHS[1:], strict=False):
        if a:  # only what goes on from a prefix that is often met
            deep = [g + p for g, often in known.often.items() for p in often if len(p) == a + 1]
            longer = longer.where(F.concat("g", F.lit("="), F.substring("rest", 1, a)).isin(deep)) if deep else longer.where("false")
        starts = longer.where(F.length("rest") > a).select("g", F.explode(F.sequence(F.lit(a + 1), F.least(F.lit(b), F.length("rest")))).alias("k"), "rest")
        for r in starts.groupBy("g", F.substr("rest", F.lit(1), F.col("k")).alias("p")).count().where(F.col("count") >= few).collect():
            known.often[r["g"]].add("=" + r["p"])
    _count_steps(rows, known, share)
    model = Model(known)
    own = {h for h, f in model.formats.items() if f.cut == math.inf}
    if own:
        got = _scored(rows.where(F.col("label") & F.col("g").isin(list(own))), model, lambda w, _: model.formats[model._head(w)].likelihood(w))
        for h in own:
            model.formats[h].cut_at({x: n for (k, x), n in got.items() if k == h}, model.quantile)
    judged = _scored(rows.where(~F.col("label")), model, lambda w, k: model.over(w, model.others[k])) if number.get(False) else {}
    drop_written(tokens)
    over, room = 0.0, number.get(False, 0) // 1000
    for (_, x), n in sorted(judged.items(), key=lambda i: -i[0][1]):
        room -= n
        if x <= 0 or room < 0:
            over = max(0.0, x)
            break
    model.margin, model.others = max(over, _margin(model, labelled_ids(250, seed=45))), []
    return model


def _count_steps(rows: DataFrame, known: Labelled, share: dict[bool, float]) -> None:
    """Adds to ``known`` the lengths and steps of all ``rows`` (label, token, g, half, rest)."""
    often = known.often

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, list[str]] = {}
            for key, half, rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words.setdefault(f"-{half}" if key == "-" else key, []).append(rest)
            made = [(k, s, c, n) for k, mine in words.items() for (s, c), n in _steps(mine, often[k[:1] if k in ("-0", "-1") else k]).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["g", "s", "c", "n"])

    steps = rows.select("g", "half", "rest").mapInArrow(of, "g string, s string, c string, n long").groupBy("g", "s", "c").agg(F.sum("n").alias("n"))
    for r in steps.collect():
        known.steps.setdefault(r["g"], Counter())[r["s"], r["c"]] += r["n"] * share[r["g"] not in ("-0", "-1")]
    for r in rows.where("label").groupBy("g", F.length("token").alias("k")).count().collect():
        known.lengths[r["g"]][r["k"]] += r["count"] * share[True]


def _scored(rows: DataFrame, model: Model, score) -> Counter:
    """(g, score) -> number of ``rows``; scores are rounded up to 1e-4."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = Counter((key, math.ceil(x * 1e4) / 1e4 if x > -math.inf else x) for key, half, w in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in (score(w, half),))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64()), pa.array(list(got.values()), pa.int64())], names=["g", "x", "n"])

    found = rows.select("g", "half", "token").mapInArrow(of, "g string, x double, n long").groupBy("g", "x").agg(F.sum("n").alias("n"))
    return Counter({(r["g"], r["x"]): r["n"] for r in found.collect()})


def _margin(model: Model, plain: list[str]) -> float:
    """What at most one in a thousand of plain tokens exceeds, and no margin under zero."""
    over = sorted((m for w in plain if (m := model.over(w)) > 0), reverse=True)
    return over[len(plain) // 1000] if len(over) > len(plain) // 1000 else 0.0


def scan(docs: DataFrame, keep: list[Column | str], model: Model | None, text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``found``: array of (start, end, kind) of each whole text.

    Null and empty texts have no spans. Base spans may overlap one another; format spans
    overlap none. Repeated rows are scanned alike and other columns are not read.
    """
    kept = docs.select(*keep)
    schema = kept.schema.simpleString()[7:-1].replace(":", " ")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t, model)] for t in b.column("_text").to_pylist()]
            yield b.drop_columns(["_text"]).append_column("found", pa.array(rows, kind))

    return docs.select(*keep, text_bytes(text_col).alias("_text")).mapInArrow(of, f"{schema}, found array<struct<start:bigint,end:bigint,kind:string>>")


def digest_columns(found: str = "found") -> dict[str, Column]:
    """Counts and digests of the spans, as the thin query returns them."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    of = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(found, lambda x: x["kind"] != "format")
    return {
        "n_assign": of("assign"),
        "n_access": of("access"),
        "n_hex": of("hex"),
        "base_sha256": F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256),
        "spans": F.array_join(F.transform(found, one), ","),
    }


def redact(docs: DataFrame, model: Model | None, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (overlapping spans by one).
    Null texts stay null; ``n_chars``, where there is such a column, follows the text."""
    schema = docs.schema
    names = schema.names
    at = names.index(text_col)

    def hide(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for s, e, _ in spans(text.encode("utf-8"), model):
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]]) if out else text

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_col):
            texts = pa.array([hide(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    out = docs.mapInArrow(of, schema)
    if "n_chars" in names and text_col != "n_chars":
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast(schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*names)
