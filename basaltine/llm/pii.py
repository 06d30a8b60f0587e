"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Base spans come from patterns and checks. The field's nodes are the tokens that hold a digit, an @ or
an (at); all other tokens are outside. Neighbours in the text are linked, and so, at any distance, are
tokens that repeat each other, have the same characters under other separators, differ in a part, or
have the same shape, each of these kinds with potentials of its own. A node knows which
base span, if any, covers it. Loopy message passing over a document's links gives each token's
label; confident tokens that no base span touches become further spans: broken repeats of what the
patterns found, and entities whose pattern failed because they stand next to each other.

Node, chain and skip weights are learned together, on whole graphs of a bounded sample of documents:
first by pseudo-likelihood, then by the gradient of loopy marginals. Each sampled document
comes as it is, labelled by its base spans, and in noised copies: with broken repeats of its spans
(separators changed, a character masked, a sign dropped), which have the label of what they repeat; with the
broken forms alone, which are outside, so that only a link makes them personal data; and with two spans side by side.

Edge cases: null and empty texts have no spans; repeated rows stay; an empty table, or a sample
without base spans, gives base spans only; further columns are ignored or kept on demand.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on, at most, and bytes of their texts (both by expectation of a hash).
FIT_ROWS, FIT_BYTES = 2000, 16 << 20

Span = tuple[int, int, int]  # start, end, index of the kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts within a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NODE = re.compile(r"[0-9@]|[(\[]at[)\]]")
_AT = re.compile(r"[(\[]at[)\]]")
_SPACE = re.compile(r"\s")
_NEXT = re.compile(r"\s+(\S{1,40})")
_EDGE = re.compile(r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9)]+$")


def _emails(text: str) -> list[Span]:
    """Anchored at each @, so a long run without one costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind."""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---------------------------------------------------------------- the graph

_BUCKETS = np.array([1, 2, 3, 5, 9, 12, 20])
FEATURES = 52
#: Kinds of links: neighbours; the same token; the same characters; all but a part of them; the same shape.
CHAIN, SAME, CHARACTERS, PART, SHAPE = range(5)
LINKS = 5
#: Tokens of a run that are compared, joined, with one token.
_RUN = 5


def _features(core: str, before: str, after: str, kind: int) -> list[int]:
    digits = sum(map(str.isdigit, core))
    dots = min(core.count("."), 4)
    letters = sum(map(str.isalpha, core))
    out = [0, 1 + int(np.searchsorted(_BUCKETS, digits, "right")), 9 + dots, 14 + min(letters, 3), 18 + min(len(core) // 4, 7)]
    flags = ("@" in core, core[:1] == "+", "-" in core, "(" in core or ")" in core, core[:1].isdigit(), core[-1:].isdigit(), digits == len(core), ":" in core or "=" in core or "/" in core)
    out += [26 + i for i, x in enumerate(flags) if x]
    out += [34 + i for i, x in enumerate((before[:1] == "+", bool(_DIGIT.search(before)), bool(_DIGIT.search(after)), after[:1] == "(", before[-1:] in ":=", not before, not after)) if x]
    if dots == 3 and not letters:
        out.append(41 + all(len(p) <= 3 for p in core.split(".")))
    if digits == len(core) and 12 <= digits <= 19:
        out.append(43 + _luhn(core))
    if kind >= 0:
        out.append(45 + kind)
    if digits and letters == 1 and core.count("x") + core.count("X"):
        out.append(49)
    if _AT.search(core):
        out.append(50)
    if re.fullmatch(r"[0-9]{3}-[0-9]{4}", core):
        out.append(51)
    return out


@dataclass
class Graph:
    """Nodes of documents (features as lists of ids) and links (first node, second node, kind)."""

    spans: list[tuple[int, int]]
    active: list[list[int]]
    links: list[tuple[int, int, int]]


def _covered(spans: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """For each node the label of the base span that covers more than half of it, or 0."""
    out, j = np.zeros(len(spans), np.int64), 0
    for s, e, kind in base:
        while j < len(spans) and spans[j][1] <= s:
            j += 1
        k = j
        while k < len(spans) and spans[k][0] < e:
            if 2 * (min(e, spans[k][1]) - max(s, spans[k][0])) > spans[k][1] - spans[k][0]:
                out[k] = kind + 1
            k += 1
    return out


def graph(text: str, base: list[Span]) -> Graph | None:
    """Candidate tokens, their features and links; a repeat is linked to the one before, so links grow with the text only."""
    cores, spans, chained, around = [], [], [], []
    end, token = -1, ""
    while m := _NODE.search(text, max(end, 0)):
        start, old, before = m.start(), end, token
        while start > max(old, 0) and not text[start - 1].isspace():
            start -= 1
        gap = _SPACE.search(text, m.end())
        end = gap.start() if gap else len(text)
        token = text[start:end]
        last = old >= 0 and text[old:start].isspace()  # the token before is a candidate, too
        if not last:
            stop = len(text[max(old, 0) : start].rstrip()) + max(old, 0)
            first = stop
            while first > max(old, 0) and not text[first - 1].isspace():
                first -= 1
            before = text[first:stop]
        core = _EDGE.sub("", token)
        if core:
            at = start + token.find(core)
            chained.append(last and bool(cores) and spans[-1][0] >= old - len(before))
            cores.append(core)
            spans.append((at, at + len(core)))
            after = _NEXT.match(text, end)
            around.append((before, after[1] if after else ""))
    if not cores:
        return None
    kinds = _covered(spans, base) - 1
    g = Graph(spans, [_features(c, b, a, k) for c, (b, a), k in zip(cores, around, kinds.tolist(), strict=True)], [])
    seen: dict[tuple, int] = {}
    runs: dict[str, tuple[int, int]] = {}  # joined characters of a run of tokens, to its first and end node
    plain: list[str] = []
    for k, core in enumerate(cores):
        if chained[k]:
            g.links.append((k - 1, k, CHAIN))
        low = core.lower()
        chars = "".join(filter(str.isalnum, _AT.sub("@", low).replace("@", "")))
        plain.append(chars)
        near: dict[int, int] = {}  # nodes linked to, the closest kind of link wins
        if ("t", low) in seen:
            near[seen["t", low]] = SAME
        if len(chars) >= 4:
            if ("c", chars) in seen:
                near.setdefault(seen["c", chars], CHARACTERS)
            if chars in runs:
                for j in range(*runs[chars]):
                    near.setdefault(j, CHARACTERS)
            if len(chars) >= 5:
                half = len(chars) // 2
                for key in (("l", len(chars), chars[:half]), ("r", len(chars), chars[half:])):
                    if key in seen:
                        near.setdefault(seen[key], PART)
                    seen[key] = k
        joined, j = chars, k
        while chained[j] and k - j < _RUN - 1:
            j -= 1
            joined = plain[j] + joined
            if len(joined) >= 9:
                if ("c", joined) in seen:  # the run repeats one token
                    one = seen["c", joined]
                    g.links += [(one, i, CHARACTERS) for i in range(j, k + 1) if one < j]
                runs[joined] = (j, k + 1)
        shape = ("s", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "0", low)))
        if shape in seen:
            near.setdefault(seen[shape], SHAPE)
        g.links += [(j, k, kind) for j, kind in near.items() if j < k]
        seen["t", low] = seen["c", chars] = seen[shape] = k
    return g


# ---------------------------------------------------------------- the field


@dataclass
class Sample:
    """Graphs put together: distinct rows of features and which of them each node has, labels, links by kind."""

    rows: np.ndarray
    which: np.ndarray
    label: np.ndarray
    links: np.ndarray

    @classmethod
    def of(cls, graphs: list[tuple[Graph, np.ndarray]]) -> Sample:
        known: dict[tuple, int] = {}
        which, links, at = [], [], 0
        for g, _ in graphs:
            which += [known.setdefault(tuple(a), len(known)) for a in g.active]
            links += [(a + at, b + at, k) for a, b, k in g.links]
            at += len(g.spans)
        rows = np.zeros((len(known), FEATURES))
        for active, i in known.items():
            rows[i, active] = 1
        links = np.array(links, np.int64).reshape(-1, 3)
        label = np.concatenate([lab for _, lab in graphs]) if graphs else np.zeros(0, np.int64)
        return cls(rows, np.array(which, np.int64), label, links[np.argsort(links[:, 2], kind="stable")])

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return (self.rows @ weights)[self.which]

    def feature_sums(self, value: np.ndarray) -> np.ndarray:
        """For each feature the sum of a value over the nodes that have it."""
        return self.rows.T @ np.stack([np.bincount(self.which, value[:, j], minlength=len(self.rows)) for j in range(value.shape[1])], 1)

    def pair_sums(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each kind of link the sum of the outer products of its ends' rows."""
        cuts = np.searchsorted(self.links[:, 2], np.arange(LINKS + 1))
        return np.stack([left[self.links[a:b, 0]].T @ right[self.links[a:b, 1]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _propagated(unary: np.ndarray, links: np.ndarray, pair: np.ndarray, turns: int, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Damped loopy belief propagation: beliefs of nodes (log), and the messages along and against each link."""
    a, b, kind = links.T
    along, against = (np.zeros((len(links), unary.shape[1]), unary.dtype) for _ in range(2))

    def beliefs() -> np.ndarray:
        out = unary.copy()
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(b, along[:, j], minlength=len(out)) + np.bincount(a, against[:, j], minlength=len(out))
        return out

    for _ in range(turns):
        belief = beliefs()
        for s in range(0, len(links), block):
            e = slice(s, s + block)
            table = pair[kind[e]]
            for sent, back, src, t in ((along, against[e].copy(), a[e], table), (against, along[e].copy(), b[e], table.transpose(0, 2, 1))):
                out = (belief[src] - back)[:, :, None] + t
                top = out.max(1)
                fresh = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                fresh -= fresh.max(1, keepdims=True)
                sent[e] = 0.5 * sent[e] + 0.5 * fresh
    return beliefs(), along, against


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    pair: np.ndarray  # kinds of links x labels x labels

    @classmethod
    def fit(cls, graphs: list[tuple[Graph, np.ndarray]], turns: int = 250, loopy: int = 10) -> Field | None:
        """Node and link weights together: pseudo-likelihood, then the gradient of loopy marginals."""
        s, n = Sample.of(graphs), len(KINDS) + 1
        if not s.label.any():
            return None
        want, (a, b, kind) = np.eye(n)[s.label], s.links.T
        w, pair = np.zeros((FEATURES, n)), np.zeros((LINKS, n, n))
        real_w, real_pair = s.feature_sums(want), s.pair_sums(want, want)
        totals = [np.full(x.shape, 1e-8) for x in (w, pair)]

        def step(dw: np.ndarray, dpair: np.ndarray, rate: float) -> None:
            dpair[SAME:] = (dpair[SAME:] + dpair[SAME:].transpose(0, 2, 1)) / 2  # repeats have no direction
            for x, d, total in ((w, dw - 0.02 * w, totals[0]), (pair, dpair - 0.02 * pair, totals[1])):
                total += d**2
                x += rate * d / np.sqrt(total)

        for _ in range(turns):
            logits = s.unary(w)
            for ends, given in ((a, pair[kind, :, s.label[b]]), (b, pair[kind, s.label[a], :])):
                for j in range(n):
                    logits[:, j] += np.bincount(ends, given[:, j], minlength=len(want))
            p = _softmax(logits)
            step(real_w - s.feature_sums(p), 2 * real_pair - s.pair_sums(p, want) - s.pair_sums(want, p), 0.5)
        for total in totals:
            total += total.max() / 20  # smaller steps from here on
        for _ in range(loopy):
            belief, along, against = _propagated(s.unary(w), s.links, pair, 8)
            joint = (belief[a] - against)[:, :, None] + (belief[b] - along)[:, None, :] + pair[kind]
            joint = _softmax(joint.reshape(len(a), -1)).reshape(joint.shape)
            expected = np.stack([joint[kind == k].sum(0) for k in range(LINKS)])
            step(real_w - s.feature_sums(_softmax(belief)), real_pair - expected, 0.5)
        return cls(w, pair)

    def marginals(self, graphs: list[Graph], turns: int = 12) -> list[np.ndarray]:
        """Label probabilities of all nodes by damped loopy belief propagation, several documents at once."""
        s = Sample.of([(g, np.zeros(0, np.int64)) for g in graphs])
        unary = s.unary(self.weights).astype(np.float32)
        p = _softmax(_propagated(unary, s.links, self.pair.astype(np.float32), turns)[0] if len(s.links) else unary)
        return np.split(p, np.cumsum([len(g.spans) for g in graphs])[:-1])


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


# ---------------------------------------------------------------- learning from noised copies


def broken(span: str, kind: int, how: int) -> str:
    """A form of an entity that its pattern misses: a character masked, separators changed, or its sign dropped or respelt."""
    if how % 3 == 0 or (kind == 2 and how % 3 == 2):
        at = [i for i, c in enumerate(span) if c.isdigit() or (kind == 0 and c == "@")]
        i = at[how // 3 % len(at)] if kind else span.index("@")
        return span[:i] + ("(at)" if span[i] == "@" else "x") + span[i + 1 :]
    if how % 3 == 1:
        if kind == 0:
            return span.replace("@", "[at]")
        if kind == 2 and span.isdigit():
            return "_./:"[how // 3 % 4].join(span[i : i + 4] for i in range(0, len(span), 4))
        return re.sub(r"[ .-]", "/" if kind == 1 else ".", span).replace("+", "")
    return span.replace("@", "(at)") if kind == 0 else span.replace(".", ":") if kind == 1 else span.replace("+", "")


def _joined(text: str, parts: list[tuple[int, str, int]]) -> tuple[str, list[Span]]:
    """The text with words put in at places between its tokens, and the spans of those that have a kind (others: -1)."""
    out, spans, at, size = [], [], 0, 0
    for place, word, kind in sorted(parts):
        out += [text[at:place], " ", word, " "]
        size += place - at + 1
        if kind >= 0:
            spans.append((size, size + len(word), kind))
        size += len(word) + 1
        at = place
    return "".join([*out, text[at:]]), spans


def _labelled(text: str, more: list[Span]) -> tuple[Graph, np.ndarray] | None:
    """A graph labelled by its base spans and further ones."""
    base = base_spans(text)
    g = graph(text, base)
    return g and (g, np.maximum(_covered(g.spans, sorted(more)), _covered(g.spans, base)))


def noised(text: str, base: list[Span], pool: list[tuple[str, int]], rng: np.random.Generator) -> list[tuple[Graph, np.ndarray]]:
    """The document, and copies of it with broken repeats, with broken forms alone, and with entities side by side."""
    gaps = [m.start() for m in re.finditer(r"(?<=\S)\s", text)] or [len(text)]
    place = lambda: gaps[int(rng.integers(len(gaps)))]
    out = [_labelled(text, [])]
    if base:
        own = [(text[s:e], kind) for s, e, kind in base]
        again, more = _joined(text, [(place(), broken(x, kind, int(rng.integers(60))), kind) for x, kind in own])
        out.append(_labelled(again, more))
    if pool:
        picked = [pool[int(i)] for i in rng.integers(len(pool), size=3)]
        alone, _ = _joined(text, [(place(), broken(x, kind, int(rng.integers(60))), -1) for x, kind in picked[:1]])
        out.append(_labelled(alone, []))
        (x, i), (y, j) = picked[1:]
        both, ((start, _, _),) = _joined(text, [(place(), f"{x} {y}", i)])
        out.append(_labelled(both, [(start, start + len(x), i), (start + len(x) + 1, start + len(x) + 1 + len(y), j)]))
    return [x for x in out if x]


#: Nodes whose messages are passed together.
NODES = 20_000


def all_spans(texts: list[str], field: Field | None, sure: float = 0.7) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans."""
    base = [base_spans(t) for t in texts]
    out = [(b, b) for b in base]
    held, nodes = [], 0
    for i, text in enumerate(texts if field else []):
        if g := graph(text, base[i]):
            held.append((i, g))
            nodes += len(g.spans)
        if held and (nodes >= NODES or i + 1 == len(texts)):
            for (k, g), p in zip(held, field.marginals([g for _, g in held]), strict=True):
                out[k] = base[k], sorted(base[k] + _added(texts[k], base[k], g, p, sure), key=lambda x: (x[0], x[2]))
            held, nodes = [], 0
    return out


def _added(text: str, base: list[Span], g: Graph, p: np.ndarray, sure: float) -> list[Span]:
    """Spans of confident nodes that no base span touches; neighbours of one label are one span."""
    label, j = p.argmax(1), 0
    taken = np.zeros(len(g.spans), bool)
    for s, e, _ in base:
        while j < len(g.spans) and g.spans[j][1] <= s:
            j += 1
        k = j
        while k < len(g.spans) and g.spans[k][0] < e:
            taken[k] = True
            k += 1
    more, last = [], -2
    for k in np.flatnonzero((label > 0) & (p.max(1) >= sure) & ~taken).tolist():
        s, e = g.spans[k]
        kind = int(label[k]) - 1
        if more and last == k - 1 and more[-1][2] == kind and text[more[-1][1] : s].isspace():
            more[-1] = (more[-1][0], e, kind)
        else:
            more.append((s, e, kind))
        last = k
    return more


def fit(documents: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Field | None:
    """A field from at most ``rows`` documents with candidates, and ``size`` bytes of text, chosen by a hash of doc_id; whole texts."""
    some = documents.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    many, total = some.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    share = min(1.0, rows / max(1, many), size / max(1, total or 0))

    def build(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [base_spans(t) for t in texts]
            pool = [(t[s:e], k) for t, b in zip(texts, found, strict=True) for s, e, k in b]
            out = []
            for t, b in zip(texts, found, strict=True):
                out += [pickle.dumps(x) for x in noised(t, b, pool, np.random.default_rng(zlib.crc32(t.encode())))]
            yield pa.record_batch([pa.array(out, pa.binary())], ["g"])

    # One order, and so one pool of spans, whatever the files: bounded by ``rows`` and ``size``.
    sample = some.where(chosen("doc_id", share)).orderBy(F.xxhash64("doc_id", "text")).select("text")
    return Field.fit([pickle.loads(r.g) for r in map_arrow(sample, build, "g binary").collect()])


def find(documents: DataFrame, field: Field | None, keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """The kept columns, base and spans (arrays of kind, start, end in code points); with ``redact`` also the text, its spans replaced by [KIND]."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        field = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            found = all_spans([t or "" for t in texts], field)
            as_rows = lambda i: pa.array([[{"kind": k, "start": a, "end": e} for a, e, k in r[i]] for r in found], span)
            clean = [redacted(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)] if redact else []
            yield pa.record_batch([*batch.columns[: len(keep)], as_rows(0), as_rows(1)] + [pa.array(clean, pa.string())] * redact, [*keep, "base", "spans"] + ["__text"] * redact)

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField("base", spans), T.StructField("spans", spans)] + [T.StructField("__text", T.StringType())] * redact)
    return map_arrow(documents.select(*keep, F.col("text").alias("__text")), run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping ones, replaced by the first one's kind."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _listed(column: str) -> F.Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counted(column: str, kind: int) -> F.Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = find(documents, fit(documents))
    counts = [_counted("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
