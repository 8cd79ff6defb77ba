"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

Patterns find the base spans. Tokens that hold a digit or an at sign, and tokens equal to the local part of an address
found, are the field's nodes; each has a label: nothing or a kind of personal data. Neighbouring nodes share chain
potentials. Successive mentions of the same or similar digits or address, wherever they stand in the document, share
skip potentials: a mention is a base span, a token or run of tokens of at least 7 digits, a part of a run that is like a
base span, or such a local part. Weights are fitted by pseudo-likelihood on documents labelled by the base spans; a node
that is no base span but like one has no known label, so it is left out there. Loopy message passing over all documents
of a batch at once gives each node's chances. Runs of nodes that are sure of a kind and touch no base span become added
spans.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm.common import sliced, smallest

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
BUCKETS = 4096
#: What mentions alike gain by equal labels, before the data say more.
SKIP_PRIOR = 9.0
#: What other labels lose where a pattern has found a span.
OBSERVED = 30.0
Span = tuple[int, int, int]

# Fixed patterns of the base spans; they are written so that no text takes more than linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_WORD = re.compile(r"\S+")
_HINT = re.compile(r"[0-9@]")
_INNER = re.compile(r"\w")
_SHAPE = ((re.compile(r"[0-9]+"), "d"), (re.compile(r"[^\W\d_]+"), "a"))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern of an address finds from the left, by growing from each at sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end:  # in steps, as the local part seldom is long
            low = max(end, start - 64)
            start = _TAIL.search(text, low, start).start()
            if start > low:
                break
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans ``(kind, start, end)`` of the patterns, by kind and start; matches that fail their test are dropped."""
    if not _HINT.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


@dataclass
class Nodes:
    """The nodes of some documents: place, features, base label, and edges of the chain and of the skips."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _bucket(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()) % BUCKETS


_cached = functools.lru_cache(100_000)(_bucket)


def _cached_bucket(text: str) -> int:
    return _cached(text) if len(text) < 200 else _bucket(text)


def _core(token: str) -> str:
    """The token without marks at its ends, or all of one that has only marks."""
    first = _INNER.search(token)
    if not first:
        return token
    end = len(token)
    while not _INNER.match(token, end - 1):
        end -= 1
    return token[first.start() : end]


def _shape(token: str) -> str:
    token = token.lower()
    for pattern, to in _SHAPE:
        token = pattern.sub(to, token)
    return token


#: Digits that a number has at least, if no pattern finds it, to share skip potentials.
LEAST_DIGITS = 7
#: Digits of the longest card number, the longest kind of number; longer ones are alike by all or the last digits only.
MOST_DIGITS = 19


def keys_of(groups: list[str]) -> list[tuple]:
    """Keys that equal or similar numbers share: all digits, the last seven, and all but one of the groups written or,
    of long numbers, of the blocks of four digits."""
    digits = "".join(groups)
    out: list[tuple] = [("all", digits)]
    if len(digits) >= LEAST_DIGITS:
        out.append(("end", digits[-LEAST_DIGITS:]))
    if len(digits) > MOST_DIGITS:  # longer than any number that is personal data
        return out
    if len(groups) >= 3:
        out += [("group", i, *groups[:i], *groups[i + 1 :]) for i in range(len(groups))]
    if len(digits) >= 12:
        out += [("block", i, len(digits), digits[:i] + digits[i + 4 :]) for i in range(0, len(digits), 4)]
    return out


@dataclass
class Mention:
    """Nodes ``first`` to ``last`` of a document as one number or address, and the digits that each has."""

    first: int
    last: int
    counts: list[int]
    base: bool
    keys: list[tuple]

    def beside(self, other: Mention) -> Iterator[tuple[int, int]]:
        """Each node, from the last, with the node of the other that has the digit as many places before its end."""
        at, covered, after = other.last, other.counts[-1], 0
        for i in range(self.last, self.first - 1, -1):
            while covered <= after and at > other.first:
                at -= 1
                covered += other.counts[at - other.first]
            yield at, i
            after += self.counts[i - self.first]


def _mentions(text: str, found: list[Span], places: list[tuple[int, int]], linked: list[bool]) -> list[Mention]:
    """The mentions among a document's nodes, by their first node, those of base spans first."""
    tokens = [text[a:b] for a, b in places]
    groups = [re.findall(r"[0-9]+", x) for x in tokens]
    counts = [sum(map(len, g)) for g in groups]
    out: dict[tuple[int, int], Mention] = {}

    def put(i: int, j: int, keys: list[tuple], base: bool) -> None:
        m = out.setdefault((i, j), Mention(i, j, counts[i : j + 1], base, []))
        m.keys += [k for k in keys if k not in m.keys]
        m.base |= base

    at, like, names = 0, set(), set()
    for k, a, b in found:
        while at < len(places) and places[at][1] <= a:
            at += 1
        last = at
        while last + 1 < len(places) and places[last + 1][0] < b:
            last += 1
        if at < len(places):
            if k == 0:
                local = _local(text, a, b)
                keys = [("mail", text[a:b].lower()), *([("local", local)] if local else [])]
                names.update([local] if local else [])
            else:
                keys = keys_of(re.findall(r"[0-9]+", text[a:b]))
            put(at, last, keys, True)
            like.update(keys if k else ())
    start = 0
    for i, token in enumerate(tokens):
        core = _core(token).lower() if names or "@" in token else ""
        if core in names:
            put(i, i, [("local", core)], False)
        if "@" in token or not counts[i]:
            if "@" in token:
                put(i, i, [("mail", core)], False)
            start = i + 1
            continue
        if start < i and not linked[i]:
            start = i
        if counts[i] >= LEAST_DIGITS:
            put(i, i, keys_of(groups[i]), False)
        if i > start and (i + 1 == len(tokens) or not linked[i + 1] or "@" in tokens[i + 1] or not counts[i + 1]):
            run = list(itertools.chain(*groups[start : i + 1]))
            if sum(counts[start : i + 1]) >= LEAST_DIGITS:
                put(start, i, keys_of(run), False)
        if like:  # parts of the run that end here
            part: list[str] = []
            for j in range(i, start - 1, -1):
                part = groups[j] + part
                if sum(map(len, part)) > MOST_DIGITS:
                    break
                keys = [x for x in keys_of(part) if x in like]
                if keys:
                    put(j, i, keys, False)
    return sorted(out.values(), key=lambda m: (m.first, not m.base, m.last))


def _skips(mentions: list[Mention]) -> list[tuple[int, int]]:
    """Edges between each mention and the one before it by each key, node by node from the end."""
    seen: dict[tuple, Mention] = {}
    edges: dict[tuple[int, int], None] = {}
    for m in mentions:
        for key in m.keys:
            old = seen.get(key)
            if old is None or old.last < m.first:
                seen[key] = m
            elif m.base and not old.base:
                seen[key] = m
                continue
            else:
                continue
            if old is None:
                continue
            edges.update(dict.fromkeys(m.beside(old)))
            edges.update(dict.fromkeys((i, at) for at, i in old.beside(m)))
    return list(edges)


def _local(text: str, a: int, b: int) -> str | None:
    """The local part of an address, if it is none that an ordinary word could be."""
    local = text[a:b].partition("@")[0].strip("._%+-").lower()
    return local if len(local) > 4 and re.search(r"[._0-9-]", local) else None


def _places(text: str, found: list[Span]) -> Iterator[tuple[int, int]]:
    """Where the nodes are."""
    locals_ = {x for k, a, b in found if k == 0 and (x := _local(text, a, b))}
    if not locals_:
        yield from (m.span() for m in _NODE.finditer(text))
        return
    for m in _WORD.finditer(text):
        if _HINT.search(m[0]) or _core(m[0]).lower() in locals_:
            yield m.span()


def _word_before(text: str, at: int) -> str:
    """The last word of letters in the 24 characters before a place; longer ones have no name in common."""
    words = re.findall(r"[^\W\d_]+", text[max(0, at - 24) : at])
    return words[-1].lower() if words else ""


def nodes_of(texts: list[str], spans: list[list[Span]]) -> Nodes:
    """The field over all the documents; a node's features are its shape, counts, and its neighbours' shapes."""
    doc, start, end, label, features, chain, skip = [], [], [], [], [], [], []
    for d, (text, found) in enumerate(zip(texts, spans, strict=True)):
        if not _HINT.search(text):
            continue
        at, last_end, first = 0, -2, len(doc)
        linked: list[bool] = []
        found = sorted(found, key=lambda s: s[1])
        for a, b in _places(text, found):
            token = text[a:b]
            while at < len(found) and found[at][2] <= a:
                at += 1
            core = _core(token)
            digits = re.sub(r"[^0-9]", "", token)
            shape = _shape(core)
            names = [f"s:{shape}", f"n:{min(len(digits), 24)}:{shape[:12]}", f"l:{shape}:{','.join(str(min(len(x), 5)) for x in re.findall(r'[0-9]+', core)[:5])}", f"p:{token[0] in '+('}:{min(len(digits), 24)}"]
            here = len(doc)
            linked.append(a - last_end <= 1)  # one space apart
            if linked[-1]:
                chain.append((here - 1, here))
                names.append("c")
            else:
                names.append(f"w:{_word_before(text, a)}")
            features.append([_cached_bucket(x) for x in names])
            doc.append(d)
            start.append(a)
            end.append(b)
            label.append(1 + found[at][0] if at < len(found) and found[at][1] < b else 0)
            last_end = b
        places = list(zip(start[first:], end[first:], strict=True))
        skip += [(first + i, first + j) for i, j in _skips(_mentions(text, found, places, linked))]
    edges = lambda x: np.array(x, dtype=np.int64).reshape(-1, 2)
    return Nodes(np.array(doc, int), np.array(start, int), np.array(end, int), np.array(label, int), np.array(features, int).reshape(-1, 5), edges(chain), edges(skip))


@dataclass
class SkipChainField:
    """Weights of features by label, and potentials of the labels at both ends of chain and skip edges."""

    emission: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, n: Nodes, rounds: int = 20, damping: float = 0.3) -> np.ndarray:
        """Each node's chances of the labels, by loopy message passing; nodes of base spans are observed."""
        score = self.emission[n.features].sum(axis=1)
        score[n.label > 0] -= OBSERVED * (1 - np.eye(LABELS)[n.label[n.label > 0]])
        edges = np.concatenate([n.chain, n.skip])
        if len(edges):
            pair = np.concatenate([np.broadcast_to(self.chain, (len(n.chain), LABELS, LABELS)), np.broadcast_to(self.skip, (len(n.skip), LABELS, LABELS))])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.zeros((len(source), LABELS))
            for _ in range(rounds):
                total = score + np.column_stack([np.bincount(target, message[:, k], len(score)) for k in range(LABELS)])
                out = total[source] - message[back]
                new = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
                new -= new.max(axis=1, keepdims=True)
                new = damping * message + (1 - damping) * new
                if np.abs(new - message).max() < 1e-4:
                    break
                message = new
            score = score + np.column_stack([np.bincount(target, message[:, k], len(score)) for k in range(LABELS)])
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def train(n: Nodes, steps: int = 200, ridge: float = 1e-3, rate: float = 1.0) -> SkipChainField:
    """Pseudo-likelihood: each node given its neighbours' labels; without nodes all weights are 0 but "nothing"."""
    emission = np.zeros((BUCKETS + 1, LABELS))
    chain, skip = np.zeros((LABELS, LABELS)), SKIP_PRIOR * np.eye(LABELS)
    if not len(n.label):
        emission[:, 0] = 5.0
        return SkipChainField(emission, chain, skip)
    a, b = n.skip.T
    unsure = (n.label[a] > 0) != (n.label[b] > 0)  # like a base span, but none: its label isn't known
    known = np.ones(len(n.label))
    known[np.where(n.label[a] > 0, b, a)[unsure]] = 0.0
    keep = lambda edges: edges[(known[edges] > 0).all(axis=1)]
    n_chain, n_skip = keep(n.chain), keep(n.skip)
    gold = np.eye(LABELS)[n.label]
    sums = [np.zeros_like(x) for x in (emission, chain, skip)]
    for _ in range(steps):
        score = emission[n.features].sum(axis=1)
        for edges, pair in ((n_chain, chain), (n_skip, skip)):
            for i, j, p in ((0, 1, pair.T), (1, 0, pair)):
                for k in range(LABELS):
                    score[:, k] += np.bincount(edges[:, i], p[n.label[edges[:, j]], k], len(score))
        p = np.exp(score - score.max(axis=1, keepdims=True))
        err = (gold - p / p.sum(axis=1, keepdims=True)) * known[:, None]
        grads = [np.zeros_like(emission), np.zeros_like(chain), np.zeros_like(skip)]
        for f in range(n.features.shape[1]):
            for k in range(LABELS):
                grads[0][:, k] += np.bincount(n.features[:, f], err[:, k], BUCKETS + 1)
        for edges, g in ((n_chain, grads[1]), (n_skip, grads[2])):
            np.add.at(g, n.label[edges[:, 0]], err[edges[:, 1]])
            np.add.at(g.T, n.label[edges[:, 1]], err[edges[:, 0]])
        for x, g, s in zip((emission, chain, skip), grads, sums, strict=True):
            g = g / len(gold) - ridge * (x - SKIP_PRIOR * np.eye(LABELS) if x is skip else x)
            s += g * g
            x += rate * g / (np.sqrt(s) + 1e-8)
    return SkipChainField(emission, chain, skip)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 15_000) -> SkipChainField:
    """Fit on at most ``max_docs`` documents, those whose hashed id is smallest, whatever their length.

    The bound is for fitting only. The labels are the base spans; nodes are made on the executors, and only their
    features, labels and edges reach the driver. With no such nodes every weight but that of "nothing" is 0.
    """
    keyed = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"))
    last = smallest(keyed.select("h"), "h", max_docs).agg(F.max("h")).first()[0]
    if last is None:
        return train(nodes_of([], []))

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [nodes_of([x], [base_spans(x)]) for x in b["text"]]
            parts = {k: [getattr(n, k).astype(np.int32).tobytes() for n in made] for k in ("label", "features", "chain", "skip")}
            yield pd.DataFrame({"h": b["h"], "t": b["t"], **parts})

    rows = keyed.filter((F.col("h") <= last) & F.col("text").rlike("[0-9@]")).select("h", F.xxhash64("text").alias("t"), "text")
    got = rows.mapInPandas(task, "h long, t long, label binary, features binary, chain binary, skip binary").orderBy("h", "t").limit(max_docs).toPandas()
    read = lambda k, width: [np.frombuffer(x, np.int32).reshape(-1, width).astype(int) for x in got[k]]
    label, features = read("label", 1), read("features", 5)
    first = np.cumsum([0, *map(len, label)])
    joined = lambda parts, width: np.concatenate([np.zeros((0, width), int), *parts])
    chain, skip = (joined([e + at for e, at in zip(read(k, 2), first, strict=False)], 2) for k in ("chain", "skip"))
    where = np.zeros(first[-1], int)
    return train(Nodes(where, where, where, joined(label, 1)[:, 0], joined(features, 5), chain, skip))


def all_spans(texts: list[str], field: SkipChainField, sure: float = 0.95) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and base and added spans, of each text."""
    base = [base_spans(x) for x in texts]
    full = [list(x) for x in base]
    n = nodes_of(texts, base)
    if len(n.label):
        chance = field.marginals(n)
        best = chance.argmax(axis=1)
        linked = set(n.chain[:, 1].tolist())
        picked = (n.label == 0) & (best > 0) & (chance.max(axis=1) >= sure)
        runs: list[list[int]] = []
        for i in np.flatnonzero(picked).tolist():
            if runs and runs[-1][-1] == i - 1 and i in linked and best[i] == best[i - 1]:
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            text, a, b = texts[n.doc[run[0]]], int(n.start[run[0]]), int(n.end[run[-1]])
            lead = "+(" if KINDS[int(best[run[0]]) - 1] == "phone" else ""
            while a < b and not (text[a].isalnum() or text[a] in lead):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if a < b:
                full[n.doc[run[0]]].append((int(best[run[0]]) - 1, a, b))
    return base, full


def _apply(docs: DataFrame, field: SkipChainField, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for part in sliced(b.column(1)):
                texts = ["" if x is None else x for x in part]
                out += [row(*x) for x in zip(texts, *all_spans(texts, shared.value), strict=True)]
            columns = [pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], f.type) for f in _arrow(schema)[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(task, schema)


def _arrow(schema: str) -> list[pa.Field]:
    return [pa.field(n, pa.string() if t == "string" else pa.int64()) for n, t in map(str.split, schema.split(", "))]


def find(docs: DataFrame, field: SkipChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans, n_added`` of each whole text.

    Spans are ``kind:start:end`` in code points, end exclusive. Null text counts as empty; null and repeated ids are
    carried as they are; other columns are ignored; an empty table gives no rows. Added spans never touch base ones.
    """

    def row(text: str, base: list[Span], full: list[Span]) -> tuple:
        counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
        return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(full), len(full) - len(base))

    return _apply(docs, field, id_col, text_col, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", row)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, field: SkipChainField, text_col: str = "text") -> DataFrame:
    """The documents with all spans of the text masked; other columns stay as they are, null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str | None] = []
            for part in sliced(b.column(at)):
                full = all_spans(["" if x is None else x for x in part], shared.value)[1]
                out += [None if x is None else masked(x, s) for x, s in zip(part, full, strict=True)]
            yield b.set_column(at, b.schema.names[at], pa.array(out, b.schema.types[at]))

    return docs.mapInArrow(task, docs.schema)
