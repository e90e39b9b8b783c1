"""Personal data by fixed patterns and by a skip-chain conditional random field.

Patterns with checks find e-mail and network addresses, card and phone numbers.  They judge each place
alone and miss what is written less neatly elsewhere in the same document: two card numbers in
a row, a phone number without its prefix.  The field labels every word that holds a digit or an
``@``.  Words next to each other share a potential, and so do words of a document that are
alike, however far apart; loopy message passing carries what a pattern has settled in one
place to the others.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomtext.llm.common import read_table, slices

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: none, then the kinds.
LABELS = 1 + len(KINDS)

ROUNDS = 12
DAMPING = 0.3
#: A word outside all patterns becomes a span if its label has this probability.
THRESHOLD = 0.5
#: Potential of a label that a pattern has settled.
SETTLED = 12.0
#: Shapes are told apart by this many hash values, which bounds the model.
SHAPES = 2048
FIT_STEPS, FIT_RATE = 400, 0.5
CLIP = 4.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always ends with its run of digits, so none starts inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)

_MARK = re.compile(r"[0-9@]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_EDGES = ".,;:!?\"'<>[]{}|=*"

SPANS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"
FACTS = "piece string, a int, b int, c int, n bigint"


# --- patterns ---------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _byte(part: str) -> bool:
    small = part.lstrip("0")
    return len(small) <= 3 and (not small or int(small) <= 255)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        # The leftmost match takes the whole run of local characters since the last one.
        start = at = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all pattern matches that pass their checks, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_byte, m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            # Long runs of digits and separators are measured before they are rewritten.
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- words of the field -------------------------------------------------------------------------


def marked_words(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an ``@``, without punctuation at their edges."""
    out, end = [], 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] not in _SPACES:
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        a, b = start, end
        while a < b and text[a] in _EDGES:
            a += 1
        while b > a and text[b - 1] in _EDGES:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _shape_key(word: str) -> str:
    """Runs of digits with their length, runs of letters, and all other characters."""
    out = []
    for t in _RUN.findall(word):
        if t[0] in "0123456789":
            out.append(f"9{min(len(t), 24)}")
        else:
            out.append("a" if t[0].isalpha() else t)
    return "".join(out)


def features(word: str) -> tuple[int, int]:
    """Hash of the shape, and what the checks of the kinds say of the word alone."""
    digits = _NOT_DIGIT.sub("", word)
    checks = 0
    if "@" in word and _DOMAIN.search(word):
        checks |= 1
    parts = word.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts):
        checks |= 2
    if 12 <= len(digits) <= 19:
        checks |= 4 if luhn(digits) else 8
    if word[0] == "+":
        checks |= 16
    return zlib.crc32(_shape_key(word).encode("utf-8")) % SHAPES, checks


def alike(word: str) -> str | None:
    """What words must share to be alike: seven last digits, the digits of an address, or the letters of a mail address."""
    if "@" in word:
        return word.lower()
    digits = _NOT_DIGIT.sub("", word)
    if len(digits) < 7:
        return None
    if word.count(".") == 3:
        return "." + digits
    # Numbers agree by their end, whatever prefix they have; cards by all of it.
    return digits if len(digits) >= 12 else digits[-7:]


def _field(text: str):
    """Base spans, words with their features and settled labels, neighbours and groups of like words of a text."""
    base = base_spans(text)
    words = marked_words(text)
    label = np.zeros(len(words), np.int64)
    settled = np.zeros(len(words), bool)
    j = 0
    by_start = sorted(base)
    for i, (a, b) in enumerate(words):
        while j < len(by_start) and by_start[j][2] <= a:
            j += 1
        k = j
        while k < len(by_start) and by_start[k][0] < b:
            if by_start[k][2] > a:
                label[i], settled[i] = by_start[k][1] + 1, True
                break
            k += 1
    chain = [
        i for i in range(len(words) - 1) if not text[words[i][1] : words[i + 1][0]].strip(" \t\n\x0b\x0c\r" + _EDGES)
    ]
    groups: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(words):
        key = alike(text[a:b])
        if key is not None:
            groups.setdefault(key, []).append(i)
    like = [g for g in groups.values() if len(g) > 1]
    return base, words, [features(text[a:b]) for a, b in words], label, settled, chain, like


# --- training -----------------------------------------------------------------------------------


def _fact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (features, label), of labels side by side and of labels of like words."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, stop in slices(texts):
            facts: Counter = Counter()
            for text in texts[start:stop]:
                if not text or not _MARK.search(text):
                    continue
                _, _, feats, label, _, chain, like = _field(text)
                for (shape, checks), y in zip(feats, label.tolist()):
                    facts["word", shape, checks, y] += 1
                for i in chain:
                    facts["chain", int(label[i]), int(label[i + 1]), 0] += 1
                for g in like:
                    for i, k in zip(g, g[1:]):
                        facts["skip", int(label[i]), int(label[k]), 0] += 1
            if facts:
                rows = list(zip(*((*key, n) for key, n in facts.items())))
                types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, types)], names=["piece", "a", "b", "c", "n"]
                )


class Model:
    """Potentials: ``word(shape, checks)``, and tables of label pairs for neighbours and like words."""

    def __init__(self, shapes: np.ndarray, checks: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.shapes, self.checks, self.chain, self.skip = shapes, checks, chain, skip

    def unary(self, feats: list[tuple[int, int]]) -> np.ndarray:
        f = np.array(feats, np.int64).reshape(-1, 2)
        return self.shapes[f[:, 0]] + self.checks[f[:, 1]]


def _pair_table(counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How much likelier two labels are on linked words than on any two words, as logarithms within bounds."""
    both = counts + counts.T + 0.5
    one = (labels + 1.0) / (labels + 1.0).sum()
    return np.clip(np.log(both / both.sum() / np.outer(one, one)), -CLIP, CLIP)


def fitted(docs: DataFrame) -> Model:
    """Potentials learned piece by piece from all texts, with the pattern matches as labels.

    The counts have a row for each (shape, checks, label) at most, which is all the driver sees.  The word piece is
    a log-linear model of shape and checks, fitted by gradient steps on the counts.
    """
    facts = (
        docs.select("text").mapInArrow(_fact_rows, FACTS).groupBy("piece", "a", "b", "c").agg(F.sum("n").alias("n"))
        .orderBy("piece", "a", "b", "c").toPandas()
    )
    pair = {}
    for piece in ("chain", "skip"):
        pair[piece] = np.zeros((LABELS, LABELS))
        rows = facts[facts["piece"] == piece]
        np.add.at(pair[piece], (rows["a"].to_numpy(), rows["b"].to_numpy()), rows["n"].to_numpy())
    rows = facts[facts["piece"] == "word"]
    shape, checks, y, n = (rows[c].to_numpy(np.int64) for c in ("a", "b", "c", "n"))
    w_shape, w_checks = np.zeros((SHAPES, LABELS)), np.zeros((32, LABELS))
    if len(n):
        # Steps are scaled by what each feature weighs, so that rare shapes learn as fast as common ones.
        seen_shape = np.bincount(shape, n, SHAPES)[:, None] + 1.0
        seen_checks = np.bincount(checks, n, 32)[:, None] + 1.0
        target = np.eye(LABELS)[y]
        for _ in range(FIT_STEPS):
            z = w_shape[shape] + w_checks[checks]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (target - p) * n[:, None]
            up_shape, up_checks = -0.5 * w_shape, -0.5 * w_checks
            np.add.at(up_shape, shape, d)
            np.add.at(up_checks, checks, d)
            w_shape += FIT_RATE * up_shape / seen_shape
            w_checks += FIT_RATE * up_checks / seen_checks
    else:
        w_shape[:, 0] = 1.0
    labels = np.bincount(y, n, LABELS)
    return Model(w_shape, w_checks, _pair_table(pair["chain"], labels), _pair_table(pair["skip"], labels))


# --- inference ------------------------------------------------------------------------------------


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(unary: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities by a fixed number of rounds of loopy sum-product.

    ``edges`` are (from, to, table) with one table for each list.  On a graph without cycles the result is
    exact once messages have crossed it.
    """
    if not edges or not sum(len(u) for u, _, _ in edges):
        return np.exp(unary - _log_sum(unary, 1)[:, None])
    u = np.concatenate([np.append(a, b) for a, b, _ in edges])
    v = np.concatenate([np.append(b, a) for a, b, _ in edges])
    table = np.concatenate([np.repeat(np.stack([t, t.T]), len(a), axis=0) for a, _, t in edges])
    size = [len(a) for a, _, _ in edges]
    back = np.concatenate([np.append(np.arange(n) + n, np.arange(n)) + 2 * sum(size[:i]) for i, n in enumerate(size)])
    messages = np.zeros((len(u), unary.shape[1]))
    for r in range(rounds):
        belief = unary.copy()
        np.add.at(belief, v, messages)
        new = _log_sum((belief[u] - messages[back])[:, :, None] + table, 1)
        new -= new.max(axis=1, keepdims=True)
        messages = new if r == 0 else DAMPING * messages + (1 - DAMPING) * new
    belief = unary.copy()
    np.add.at(belief, v, messages)
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def found_spans(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the spans of the patterns, and those with what the field adds.

    Texts have no edge in common, so all their fields are solved side by side.  Like words meet in one node of their
    group, so a group of any size has one edge a word.
    """
    fields = [_field(text) for text in texts]
    sizes = [len(f[1]) for f in fields]
    first = np.cumsum([0, *sizes])
    words = int(first[-1])
    every = [x for f in fields for x in f[2]]
    if not words:
        return [(f[0], f[0]) for f in fields]
    label, settled = np.concatenate([f[3] for f in fields]), np.concatenate([f[4] for f in fields])
    unary = model.unary(every)
    rows = np.flatnonzero(settled)
    unary[rows] = 0.0
    unary[rows, label[rows]] = SETTLED
    groups = [[i + off for i in g] for f, off in zip(fields, first) for g in f[6]]
    unary = np.vstack([unary, np.zeros((len(groups), LABELS))])
    left = np.array([i + off for f, off in zip(fields, first) for i in f[5]], np.int64)
    member = np.array([i for g in groups for i in g], np.int64)
    hub = np.repeat(np.arange(len(groups)) + words, [len(g) for g in groups]).astype(np.int64)
    p = marginals(unary, [(left, left + 1, model.chain), (member, hub, model.skip)])[:words]
    best, sure = p.argmax(axis=1), p.max(axis=1) >= THRESHOLD
    out = []
    for f, off, n in zip(fields, first, sizes):
        base, places, side_by_side = f[0], f[1], set(f[5])
        new: list[tuple[int, int, int]] = []
        mine = slice(off, off + n)
        for i in np.flatnonzero(~settled[mine] & (best[mine] > 0) & sure[mine]).tolist():
            a, b = places[i]
            kind = int(best[off + i]) - 1
            if kind == 3 and new and new[-1][1] == 3 and i - 1 in side_by_side and new[-1][2] == places[i - 1][1]:
                new[-1] = (new[-1][0], 3, b)
            else:
                new.append((a, kind, b))
        out.append((base, sorted(base + new)))
    return out


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with counts of pattern matches by kind, ``base`` and ``spans``.

    Defined cases: null and empty texts have no spans; null ids and repeated rows are judged row by row; a span that
    two kinds match is listed for both; an empty table gives no rows and an untrained model adds no spans; columns that have the
    names of results are replaced, others stay.  Texts are read whole: patterns, words and messages take time in
    proportion to the length, a document's field lies in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs) if model is None else model)
    names = [f.split()[0] for f in SPANS.split(", ")]
    mine = docs.drop(*names)
    keys = [f"_{i}" for i in range(len(mine.columns))]
    renamed = mine.toDF(*keys)
    place = mine.columns.index("text")
    schema = ", ".join([*(f"{k} {f.dataType.simpleString()}" for k, f in zip(keys, mine.schema)), SPANS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            rows = [(0, 0, 0, 0, "", "")] * len(texts)
            for start, stop in slices(texts):
                at = [i for i in range(start, stop) if texts[i] and _MARK.search(texts[i])]
                for i, (base, every) in zip(at, found_spans([texts[i] for i in at], shared.value)):
                    counts = Counter(k for _, k, _ in base)
                    rows[i] = (*(counts[k] for k in range(len(KINDS))), joined(base), joined(every))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*keys, *names]
            )

    return renamed.mapInArrow(run, schema).toDF(*mine.columns, *names)


def op13_skip_chain_pii(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data(docs).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )
