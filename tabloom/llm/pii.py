"""Personal data: exact patterns joined by a semi-Markov conditional random field.

The patterns find emails, IP addresses, payment cards and phone numbers (base
spans, always kept).  A semi-Markov CRF then reads every island, a run of blank-separated tokens
with a digit or an ``@``.  Its features describe whole candidate spans (shape, digits,
checksum, context), and dynamic programming over spans of at most ``MAX_TOKENS`` tokens chooses
boundaries and kinds together.  Spans it finds that touch no base span are added.

The model is trained here by maximum likelihood (forward-backward over segmentations) on
at most ``FIT_ISLANDS`` distinct islands with the smallest hashes, labelled by the patterns, and on copies
of them written differently (no plus sign, other separators, spelt-out ``@``), so that it learns
more than the patterns.  The sample's bound is a parameter; detection reads whole texts.

Offsets are code points, end exclusive.  Defined cases: NULL and empty texts have no spans;
repeated rows are treated alike; other columns pass through, only the result column replaces
one of its own name; with no islands there is no model and only base spans are found.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.words import portions

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 6
FIT_ISLANDS = 3_000
LEAST_CHANCE = 0.9
SPANS_TYPE = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind and possessive runs find the same matches without quadratic retries.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_NEXT = re.compile(r" (?=[^\s0-9@]*[0-9@])\S+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_RUN = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|(.)\1*", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, sorted."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of blank-separated tokens that all hold a digit or an ``@``."""
    mark = _MARK.search(text)
    while mark:
        start = mark.start()
        while start and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, mark.end()).end()
        more = _NEXT.match(text, end)
        while more:
            end = more.end()
            more = _NEXT.match(text, end)
        yield start, end
        mark = _MARK.search(text, end)


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def _shape(span: str) -> str:
    """Runs of digits, letters and signs with the length of the digit runs."""
    out = []
    for m in _RUN.finditer(span):
        c = m.group()
        out.append(f"d{min(len(c), 9)}" if c[0].isdigit() else "a" if c[0].isalpha() else c[0])
    return "".join(out[:24])


def span_features(span: str, before: str, tokens: int) -> list[str]:
    """What a whole candidate span looks like; ``before`` is the word in front of it."""
    digits = _NOT_DIGIT.sub("", span)
    shape = _shape(span)
    parts = span.split(".")
    features = [
        "bias", f"shape {shape}", "plain " + re.sub(r"(?:d[1-9]|a)+", lambda m: m.group()[0], shape),
        f"digits {len(digits)}", f"tokens {tokens}", f"first {_shape(span[:1])}", f"last {_shape(span[-1:])}",
        f"letters {any(c.isalpha() for c in span)}", f"before {_shape(before[-1:])}",
    ]
    if "@" in span:
        features.append(f"at {span.count('@')} {'.' in span.rpartition('@')[2]}")
    if 12 <= len(digits) <= 19 and not any(c not in "0123456789 -" for c in span):
        features.append(f"luhn {luhn(digits)}")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        features.append(f"octets {all(map(_octet, parts))}")
    return features


class _Island:
    """Candidate segments of one island: (first token, last token + 1, start, end, features)."""

    def __init__(self, text: str, before: str = "", most: int = MAX_TOKENS):
        self.tokens = _tokens(text)
        self.segments = []
        for i, (start, _) in enumerate(self.tokens):
            front = text[max(0, start - 20) : start].rstrip().rpartition(" ")[2] if start else before
            for j in range(i + 1, min(i + most, len(self.tokens)) + 1):
                a, b = _trim(text, start, self.tokens[j - 1][1])
                if a < b:
                    self.segments.append((i, j, a, b, span_features(text[a:b], front, j - i)))


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class SemiCrf:
    """Scores are sums of feature weights by kind, and of a weight for each pair of neighbours."""

    def __init__(self, weights: dict[str, np.ndarray], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs  # pairs[previous, kind], kind 0 = outside

    def scores(self, island: _Island) -> list[np.ndarray]:
        total = []
        for *_, features in island.segments:
            s = np.zeros(len(KINDS))
            for f in features:
                if f in self.weights:
                    s += self.weights[f]
            total.append(s)
        return total

    def chart(self, island: _Island) -> list[list[tuple]]:
        """By end token: (start token, kind, score, segment number); outside is one token."""
        ends = [[] for _ in range(len(island.tokens) + 1)]
        for t in range(len(island.tokens)):
            ends[t + 1].append((t, 0, 0.0, -1))
        for number, (segment, s) in enumerate(zip(island.segments, self.scores(island))):
            for kind in range(len(KINDS)):
                ends[segment[1]].append((segment[0], kind + 1, float(s[kind]), number))
        return ends

    def marginals(self, island: _Island):
        """(log Z, {(number, kind, previous): chance}) by forward-backward."""
        ends, n, k = self.chart(island), len(island.tokens), len(KINDS) + 1
        pairs = self.pairs.tolist()
        forward = [[-math.inf] * k for _ in range(n + 1)]
        forward[0][0] = 0.0
        for t in range(1, n + 1):
            by_kind = [[] for _ in range(k)]
            for start, kind, score, _ in ends[t]:
                by_kind[kind] += [forward[start][p] + pairs[p][kind] + score for p in range(k) if forward[start][p] > -math.inf]
            forward[t] = [_log_sum(v) if v else -math.inf for v in by_kind]
        backward = [[-math.inf] * k for _ in range(n + 1)]
        backward[n] = [0.0] * k
        for t in range(n, 0, -1):
            for start, kind, score, _ in ends[t]:
                if backward[t][kind] > -math.inf:
                    for p in range(k):
                        value = backward[t][kind] + pairs[p][kind] + score
                        old = backward[start][p]
                        backward[start][p] = value if old == -math.inf else _log_sum([old, value])
        z = _log_sum([v for v in forward[n] if v > -math.inf])
        chances = {}
        for t in range(1, n + 1):
            for start, kind, score, number in ends[t]:
                for p in range(k):
                    if forward[start][p] > -math.inf and backward[t][kind] > -math.inf:
                        c = math.exp(forward[start][p] + pairs[p][kind] + score + backward[t][kind] - z)
                        if c > 1e-9:
                            chances[number, start, t, kind, p] = c
        return z, chances

    def decode(self, island: _Island) -> list[tuple[int, int, int, float]]:
        """(start, kind, end, chance) of the best segmentation's entities."""
        ends, n, k = self.chart(island), len(island.tokens), len(KINDS) + 1
        pairs = self.pairs.tolist()
        best = [[(-math.inf, None)] * k for _ in range(n + 1)]
        best[0][0] = (0.0, None)
        for t in range(1, n + 1):
            for start, kind, score, number in ends[t]:
                for p in range(k):
                    value = best[start][p][0] + pairs[p][kind] + score
                    if value > best[t][kind][0]:
                        best[t][kind] = (value, (start, p, number))
        t, kind = n, max(range(k), key=lambda x: best[n][x][0])
        chosen = []
        while t:
            start, p, number = best[t][kind][1]
            if kind:
                chosen.append((number, kind))
            t, kind = start, p
        if not chosen:
            return []
        chance = {}
        for (number, _, _, kind, _), c in self.marginals(island)[1].items():
            chance[number, kind] = chance.get((number, kind), 0.0) + c
        out = []
        for number, kind in reversed(chosen):
            _, _, a, b, _ = island.segments[number]
            out.append((a, kind - 1, b, chance.get((number, kind), 0.0)))
        return out


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Copies of a labelled island with its entities in other writing."""
    changes = {
        0: (lambda s: s.replace("@", "(@)", 1), lambda s: s.replace("@", "[at]@", 1)),
        1: (lambda s: s.replace(".", ":"), lambda s: s.replace(".", "-")),
        2: (lambda s: re.sub(r"\D", "", s), lambda s: ".".join(re.findall(r"\d{1,4}", re.sub(r"\D", "", s)))),
        3: (lambda s: s.lstrip("+"), lambda s: "00" + re.sub(r"[().+]", "", s), lambda s: s.replace(" ", "/")),
    }
    for version in range(3):
        out, place, done = [], [], 0
        for a, kind, b in spans:
            if a < done:
                return
            new = changes[kind][version % len(changes[kind])](text[a:b])
            out.append(text[done:a])
            start = sum(map(len, out))
            out.append(new)
            place.append((start, kind, start + len(new)))
            done = b
        out.append(text[done:])
        yield "".join(out), place


def _gold(island: _Island, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]] | None:
    """(segment number, kind) of labelled spans, None if one of them is no candidate."""
    by_place = {(a, b): i for i, (_, _, a, b, _) in enumerate(island.segments)}
    chosen, done = [], 0
    for a, kind, b in sorted(spans, key=lambda s: (s[0], s[0] - s[2])):
        if a < done:
            continue
        if (a, b) not in by_place:
            return None
        chosen.append((by_place[a, b], kind))
        done = b
    return chosen


def train(samples: list[tuple[str, str]], epochs: int = 4, l2: float = 1e-5) -> SemiCrf:
    """Fit on (island, word before) pairs labelled by the patterns, with rewritten copies."""
    examples = []
    for text, before in samples:
        spans = base_spans(text)
        for body, place in [(text, spans), *(rewritten(text, spans) if spans else [])]:
            if len(_tokens(body)) <= 40:
                island = _Island(body, before)
                gold = _gold(island, place)
                if gold is not None:
                    examples.append((island, gold))
    # Adagrad: early examples don't outweigh later ones of the same feature.
    weights: dict[str, np.ndarray] = {}
    squares: dict[str, np.ndarray] = {}
    pairs = np.zeros((len(KINDS) + 1,) * 2)
    model, order = SemiCrf(weights, pairs), np.random.default_rng(7)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            island, gold = examples[e]
            gradient: dict[str, np.ndarray] = {}
            pair_gradient = np.zeros_like(pairs)

            def add(number: int, kind: int, amount: float) -> None:
                for f in island.segments[number][4]:
                    gradient.setdefault(f, np.zeros(len(KINDS)))[kind - 1] += amount

            for (number, _, _, kind, p), c in model.marginals(island)[1].items():
                pair_gradient[p, kind] -= c
                if kind:
                    add(number, kind, -c)
            inside = {island.segments[n][0]: (n, kind + 1) for n, kind in gold}
            t, p = 0, 0
            while t < len(island.tokens):
                number, kind = inside.get(t, (-1, 0))
                pair_gradient[p, kind] += 1
                if kind:
                    add(number, kind, 1.0)
                t, p = (island.segments[number][1] if kind else t + 1), kind
            for f, g in gradient.items():
                w = weights.setdefault(f, np.zeros(len(KINDS)))
                s = squares.setdefault(f, np.full(len(KINDS), 1e-2))
                s += g * g
                w += 0.3 * (g - l2 * w) / np.sqrt(s)
            pairs += 0.02 * pair_gradient
    return model


def fit(documents: DataFrame, text: str = "text", most: int = FIT_ISLANDS) -> SemiCrf:
    """Train on the ``most`` distinct islands with the smallest hashes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = {}
            for body in batch.column(0).to_pylist():
                for a, b in islands(body or ""):
                    if b - a <= 200:
                        found[body[a:b], body[max(0, a - 20) : a].rstrip().rpartition(" ")[2]] = 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())],
                names=["island", "before"],
            )

    rows = documents.select(text).mapInArrow(gather, "island string, before string").distinct()
    rows = rows.orderBy(F.xxhash64("island"), "island", "before").limit(most).collect()
    return train([(r.island, r.before) for r in rows])


def find_spans(text: str, model: SemiCrf | None, least: float = LEAST_CHANCE) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) sorted by start, then kind."""
    base = base_spans(text)
    found = [(*span, True) for span in base]
    if model and model.weights:
        starts, ends = _union(base)
        for a, b in islands(text):
            i = bisect_right(starts, a + 2) - 1
            if i >= 0 and ends[i] >= b - 2:  # a base span fills it but for a few signs
                continue
            before = text[max(0, a - 20) : a].rstrip().rpartition(" ")[2]
            for start, kind, end, chance in model.decode(_Island(text[a:b], before)):
                s, e = a + start, a + end
                i = bisect_right(starts, e - 1) - 1
                if chance >= least and (i < 0 or ends[i] <= s):
                    found.append((s, kind, e, False))
    found.sort()
    return found


def _union(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that sorted spans cover."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def personal_data(documents: DataFrame, model: SemiCrf, text: str = "text") -> Column:
    """All spans of a text, sorted by start and kind."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    order = pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "base": pa.bool_()})

    @F.arrow_udf(SPANS_TYPE)
    def find(column: pa.Array) -> pa.Array:
        parts = []
        for part in portions([column]):
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in find_spans(body or "", shared.value)]
                for body in part.to_pylist()
            ]
            parts.append(pa.array(rows, pa.list_(order)))
        return pa.concat_arrays(parts)

    return find.asNondeterministic()(F.col(text))


def annotate(documents: DataFrame, text: str = "text", into: str = "pii", model: SemiCrf | None = None) -> DataFrame:
    return documents.withColumn(into, personal_data(documents, model or fit(documents, text), text))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(documents: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """Replace every span by ``[KIND]``; spans that overlap become one, named by the first.

    ``length`` names a column that holds the text's length and is brought up to date.
    """
    model = fit(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def hide(column: pa.Array) -> pa.Array:
        parts = []
        for part in portions([column]):
            texts = part.to_pylist()
            for i, body in enumerate(texts):
                out, done = [], 0
                for a, kind, b, _ in find_spans(body or "", shared.value):
                    if a >= done:
                        out += [body[done:a], f"[{KINDS[kind].upper()}]"]
                    done = max(done, b)
                if out:
                    texts[i] = "".join([*out, body[done:]])
            parts.append(pa.array(texts, pa.string()))
        return pa.concat_arrays(parts)

    result = documents.withColumn(text, hide.asNondeterministic()(F.col(text)))
    if length:
        result = result.withColumn(length, F.coalesce(F.length(text).cast(documents.schema[length].dataType), F.col(length)))
    return result
