"""Secret scan: fixed rules, and a character convolutional network over every candidate and what stands around it.

A candidate is a maximal run of 12 or more letters, digits and ``+/_=.-``. Three banks of filters read its characters, the 24 before
it and the 8 behind it; each filter's highest answer counts, so a candidate of any length is read whole. The network learns from
all labelled findings, group by group, and the groups' networks are averaged after each pass; a held-back part, all of it, calibrates
its answers and sets a threshold for each kind of alphabet: the highest one that still finds the asked share of the labelled secrets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import frugal, stored
from panelwright.llm.textnum import pieces, rows_of

#: The rules of each kind, in the order in which kinds of one start are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "net")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
LEFT, RIGHT, CHUNK = 24, 8, 48
_OTHER, _NONE, _CLASSES = 128, 129, 130  # characters beyond ASCII, and no character
_WIDTHS, _FILTERS, _HIDDEN = (4, 5, 3), (32, 16, 8), 16
SHAPES = ("hex", "upper", "mixed")
_HEX, _UPPER = re.compile(r"[0-9a-f]+"), re.compile(r"[A-Z0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the rules' findings: matches of a kind don't overlap, and too short ones are dropped after."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether a rule's finding overlaps it) of every candidate."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][1] < b:
            reach = max(reach, base[at][2])
            at += 1
        out.append((a, b, reach > a))
    return out


def shape_of(candidate: str) -> int:
    return 0 if _HEX.fullmatch(candidate) else 1 if _UPPER.fullmatch(candidate) else 2


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes == 0, _NONE, np.where(codes < 128, codes, _OTHER)).astype(np.uint8)


class _Windows:
    """Characters of many candidates: the candidates in chunks of 48 with the owner of each, and what stands left and right."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray):
        chars = np.concatenate([np.full(LEFT, _NONE, np.uint8), _classes(text), np.full(RIGHT + CHUNK + 4, _NONE, np.uint8)])
        per = -(-(end - start) // CHUNK)
        self.owner = np.repeat(np.arange(len(start)), per)
        first = start[self.owner] + CHUNK * (np.arange(len(self.owner)) - (np.cumsum(per) - per)[self.owner])
        at = first[:, None] + np.arange(CHUNK + _WIDTHS[0] - 1)
        self.own = np.where(at < end[self.owner][:, None], chars[at + LEFT], _NONE)
        self.left = chars[start[:, None] + np.arange(LEFT)]
        self.right = chars[end[:, None] + LEFT + np.arange(RIGHT)]


class SecretNet:
    """The network: tables of filter answers by place and character, a hidden layer, and the calibration."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {}
        for i, (w, f) in enumerate(zip(_WIDTHS, _FILTERS, strict=True)):
            self.p[f"t{i}"] = rng.normal(0, 0.3, (w, _CLASSES, f)).astype(np.float32)
            self.p[f"b{i}"] = np.zeros(f, np.float32)
        self.p["h"] = rng.normal(0, 0.2, (sum(_FILTERS), _HIDDEN)).astype(np.float32)
        self.p["hb"] = np.zeros(_HIDDEN, np.float32)
        self.p["o"] = rng.normal(0, 0.2, _HIDDEN).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)
        self.slope, self.offset = 1.0, 0.0
        self.thresholds = np.ones(len(SHAPES))

    def _answers(self, bank: int, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest answer of each filter over a row's places, and the place."""
        table = self.p[f"t{bank}"]
        w = len(table)
        n = chars.shape[1] - w + 1
        total = table[0][chars[:, :n]]
        for i in range(1, w):
            total += table[i][chars[:, i : i + n]]
        if bank == 0:  # places behind the candidate's end don't count
            total[chars[:, :n] == _NONE] = -1e9
        at = total.argmax(1)
        return np.take_along_axis(total, at[:, None], 1)[:, 0] + self.p[f"b{bank}"], at

    def _pooled(self, windows: _Windows, rows: slice, chunks: slice) -> np.ndarray:
        own, _ = self._answers(0, windows.own[chunks])
        owner = windows.owner[chunks] - rows.start
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        return np.concatenate([np.maximum.reduceat(own, first, 0), self._answers(1, windows.left[rows])[0], self._answers(2, windows.right[rows])[0]], 1)

    def _logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.maximum(pooled, 0) @ self.p["h"] + self.p["hb"])
        return (hidden @ self.p["o"] + self.p["ob"][0]).astype(np.float64)

    def logits(self, text: str, start: np.ndarray, end: np.ndarray, together: int = 512) -> np.ndarray:
        """Uncalibrated answers for candidates of one text, ``together`` chunks of 48 characters at a time."""
        out = np.zeros(len(start))
        chunks = np.cumsum(-(-(end - start) // CHUNK))
        at = 0
        while at < len(start):
            before = chunks[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(chunks, before + together, "right")))
            if chunks[at] - before > together:  # one long candidate: its answers are joined chunk by chunk
                out[at] = self._logits(self._long(text, int(start[at]), int(end[at]), together))[0]
                at += 1
                continue
            part = _Windows(text[int(start[at]) - min(LEFT, int(start[at])) : int(end[to - 1]) + RIGHT], start[at:to] - start[at] + min(LEFT, int(start[at])), end[at:to] - start[at] + min(LEFT, int(start[at])))
            out[at:to] = self._logits(self._pooled(part, slice(0, to - at), slice(0, len(part.owner))))
            at = to
        return out

    def _long(self, text: str, start: int, end: int, together: int) -> np.ndarray:
        best = None
        step = CHUNK * together
        for a in range(start, end, step):
            b = min(end, a + step + _WIDTHS[0] - 1)
            part = _Windows(text[a:b], np.array([0]), np.array([b - a]))
            own = self._answers(0, part.own)[0].max(0)
            best = own if best is None else np.maximum(best, own)
        lo = max(0, start - LEFT)
        around = _Windows(text[lo:start] + "?" + text[end : end + RIGHT], np.array([start - lo]), np.array([start - lo + 1]))
        return np.concatenate([best[None], self._answers(1, around.left)[0], self._answers(2, around.right)[0]], 1)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * logits + self.offset, -40, 40)))

    def step(self, windows: _Windows, rows: np.ndarray, label: np.ndarray, blank: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over some rows whose candidates are one chunk each; ``blank`` rows hide what stands around."""
        chars = [windows.own[rows], windows.left[rows].copy(), windows.right[rows].copy()]
        chars[1][blank], chars[2][blank] = _NONE, _NONE
        got = [self._answers(i, c) for i, c in enumerate(chars)]
        pooled = np.concatenate([g for g, _ in got], 1)
        active = np.maximum(pooled, 0)
        hidden = np.tanh(active @ self.p["h"] + self.p["hb"])
        z = hidden @ self.p["o"] + self.p["ob"][0]
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight / len(rows)).astype(np.float32)
        grad = {"o": hidden.T @ d, "ob": np.array([d.sum()], np.float32)}
        dh = d[:, None] * self.p["o"] * (1 - hidden**2)
        grad["h"], grad["hb"] = active.T @ dh, dh.sum(0)
        dp = (dh @ self.p["h"].T) * (pooled > 0)
        lo = 0
        for i, (c, (_, at)) in enumerate(zip(chars, got, strict=True)):
            f = at.shape[1]
            part = dp[:, lo : lo + f]
            lo += f
            g = np.zeros_like(self.p[f"t{i}"])
            for w in range(len(g)):
                np.add.at(g[w], (np.take_along_axis(c, at + w, 1), np.arange(f)[None, :]), part)
            grad[f"t{i}"], grad[f"b{i}"] = g, part.sum(0)
        return grad


def _passed(net: SecretNet, adam: tuple, rows: list[tuple[int, str, str, str]], passes: int, rate: float, rng: np.random.Generator) -> tuple:
    """``passes`` of Adam on the log loss over a block of (label, before, candidate, behind); a candidate of several chunks is trained on its first one.

    A step has up to 128 others and 32 secrets, which weigh the same together. Every row is in each pass; the fewer ones of a label go round again.
    """
    text, start, end = _joined(rows)
    label = np.array([r[0] for r in rows], np.float32)
    windows = _Windows(text, start, np.minimum(end, start + CHUNK))
    windows.right = _Windows(text, np.maximum(end - 1, start), end).right
    m, v, t = adam
    sides = [(np.flatnonzero(label == x), n) for x, n in ((0, 128), (1, 32))]
    steps = max(-(-len(own) // n) for own, n in sides)
    for _ in range(passes):
        turn = [(np.resize(rng.permutation(own), steps * n), n) for own, n in sides if len(own)]
        for i in range(steps):
            chosen = np.concatenate([own[i * n : i * n + n] for own, n in turn])
            weight = np.concatenate([np.full(n, 1 / (2 * n)) for _, n in turn]) * len(chosen)
            grad = net.step(windows, chosen, label[chosen], rng.random(len(chosen)) < 0.3, weight.astype(np.float32))
            t += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return m, v, t


def _joined(rows: list[tuple[int, str, str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """(text, start, end) of the candidates of (label, before, candidate, behind), one after the other: a row's surroundings end where the next row's begin."""
    text, start, end, size = [], [], [], 0
    for _, before, candidate, behind in rows:
        text += [before.rjust(LEFT, "\0"), candidate, behind.ljust(RIGHT, "\0")]
        start.append(size + LEFT)
        end.append(size + LEFT + len(candidate))
        size += LEFT + len(candidate) + RIGHT
    return "".join(text), np.array(start, np.int64), np.array(end, np.int64)


def _averaged(findings: DataFrame, net: SecretNet, groups: int, passes: int, rate: float, seed: int) -> None:
    """One pass over all ``findings`` (group, digest, ...): each group trains from ``net`` in the order of its digests, and ``net`` becomes the mean by rows."""
    names, block = list(net.p), 16_384

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> pa.RecordBatch:
            flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float32).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([flat], pa.binary())], names=["group", "n", "p"])

        group, n, held, own, adam, rng = None, 0, [], net, None, None
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "label", "before", "candidate", "behind")), strict=True):
                if g != group or len(held) == block:
                    if held:
                        adam = _passed(own, adam, held, passes, rate, rng)
                        n, held = n + len(held), []
                    if g != group:
                        if group is not None:
                            yield ended()
                        own, rng, group, n = SecretNet(seed), np.random.default_rng([seed, g]), g, 0
                        own.p = dict(net.p)
                        adam = ({k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0)
                held.append(tuple(row))
        if held:
            adam = _passed(own, adam, held, passes, rate, rng)
            n += len(held)
        if group is not None:
            yield ended()

    dealt = findings.repartition(groups, "group").sortWithinPartitions("group", "digest")
    got = sorted(dealt.mapInArrow(frugal(run), "group int, n long, p binary").collect())  # a row for each of at most ``groups`` groups
    mean = sum(r.n * np.frombuffer(r.p, np.float32).astype(np.float64) for r in got) / sum(r.n for r in got)
    at = 0
    for k in names:
        size = net.p[k].size
        net.p[k] = mean[at : at + size].reshape(net.p[k].shape).astype(np.float32)
        at += size


def _calibrate(net: SecretNet, findings: DataFrame, ones: int, zeros: int, recall: float) -> None:
    """Slope and offset by Newton steps on softened labels over all ``findings``, then each shape's threshold, an exact one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("label", "before", "candidate", "behind")), strict=True))
            if rows:
                text, start, end = _joined(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([shape_of(r[2]) for r in rows], pa.int32()), pa.array(net.logits(text, start, end), pa.float64())], names=["label", "shape", "x"])

    answers = stored(findings.select("label", "before", "candidate", "behind").mapInArrow(frugal(run), "label int, shape int, x double"), "answers")
    by = {r.shape: r.n for r in answers.where("label = 1").groupBy("shape").agg(F.count("*").alias("n")).collect()}
    target = F.when(F.col("label") == 1, (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        x = F.col("x")
        z = x * float(w[0]) + float(w[1])
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z
        q, d = p * (1 - p), p - target
        r = answers.agg(*[F.sum(c) for c in (loss, d * x, d, q * x * x, q * x, q)]).first()  # one row
        return r[0] + 1e-3 * float(w @ w), np.array(r[1:3]) + 2e-3 * w, np.array([[r[3], r[4]], [r[4], r[5]]]) + 2e-3 * np.eye(2)

    w = np.array([1.0, 0.0])
    loss, slope, curve = sums(w)
    for _ in range(15):
        step = np.linalg.solve(curve, slope)
        while True:  # full steps overshoot where the labels part cleanly
            tried = sums(w - step)
            if tried[0] <= loss or np.abs(step).max() <= 1e-6:
                break
            step = step / 2
        w, (loss, slope, curve) = w - step, tried
        if np.abs(step).max() <= 1e-6:
            break
    net.slope, net.offset = float(w[0]), float(w[1])
    found = answers.where("label = 1")
    for s in range(len(SHAPES)):
        n, own = (by[s], found.where(F.col("shape") == s)) if by.get(s, 0) >= 20 else (ones, found)  # too few of this shape: all shapes together
        at = int(np.floor((1 - recall) * n))
        net.thresholds[s] = net.probability(own.orderBy("x").offset(at).limit(1).first().x)


def labelled_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, label, before, candidate, behind): all distinct candidates of all rows with their surroundings, label 1 where a rule finds them."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return stored(_found(rows).dropDuplicates(["digest"]), "findings")


def _found(rows: DataFrame, per_row: int | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, t in rows_of(batch, "key", "text"):
                s, own = t.decode(), []
                for a, b, hit in candidates(s, base_spans(s)):
                    context = s[max(0, a - LEFT) : a], s[a:b], s[b : b + RIGHT]
                    own.append((hashlib.blake2b("\0".join((str(int(hit)), *context)).encode(), digest_size=16).hexdigest(), int(hit), *context))
                out += own if per_row is None else sorted(own)[:per_row]
            yield pa.RecordBatch.from_pylist([dict(zip(("digest", "label", "before", "candidate", "behind"), o, strict=True)) for o in out], schema=pa.schema([("digest", pa.string()), ("label", pa.int32()), ("before", pa.string()), ("candidate", pa.string()), ("behind", pa.string())]))

    return rows.mapInArrow(frugal(run), "digest string, label int, before string, candidate string, behind string")


def sample_findings(docs: DataFrame, rows: int = 30_000, per_row: int = 64, bound: int = 4_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`labelled_findings`, of a sample, for a quick look: no query fits to it.

    About ``rows`` rows of ``docs``, of each the ``per_row`` candidates of the least digests, and of all those the ``bound`` secrets and twice as many
    others with the least digests. Reruns agree.
    """
    rows_in = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    total = rows_in.count()
    if total > rows:
        share = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < int((1 << 20) * rows / total) + 1
        rows_in = rows_in.where(share)
    found = stored(_found(rows_in, per_row).dropDuplicates(["digest"]), "findings")
    return found.where("label = 1").orderBy("digest").limit(bound).unionByName(found.where("label = 0").orderBy("digest").limit(2 * bound))


def fit_secret_net(findings: DataFrame, recall: float = 0.9, epochs: int = 4, seed: int = 7, groups: int = 64) -> SecretNet | None:
    """The network of a table of labelled findings (digest, label, before, candidate, behind), all of them; None without both labels.

    Every fourth finding by digest is held back for calibration and thresholds. The others are dealt to groups by digest, 64 at most and one for 8,192 findings;
    each pass trains every group from the same network, by blocks of 16,384 findings, and averages what they come to, so no task holds more than a block and the driver
    holds a network for each group. Few findings are gone over several times in a pass. Reruns agree.
    """
    digit = lambda at, n: F.conv(F.substring("digest", at, n), 16, 10).cast("int")
    held = digit(-1, 1) % 4 == 0
    count = {(r.held, r.label): r.n for r in findings.groupBy(held.alias("held"), "label").agg(F.count("*").alias("n")).collect()}
    if not all((h, x) in count for h in (True, False) for x in (0, 1)):
        return None
    n = count[False, 0] + count[False, 1]
    many = max(1, min(groups, n // 8192))
    learnt = findings.where(~held).withColumn("group", digit(1, 6) % many)
    net = SecretNet(seed)
    for epoch in range(epochs):
        _averaged(learnt, net, many, max(1, 160_000 // (n * epochs)) if many == 1 else 1, 0.01 * (1 - epoch / epochs) ** 2, seed + epoch)
    _calibrate(net, findings.where(held), count[True, 1], count[True, 0], recall)
    return net


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, net: SecretNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_net), one row per row of ``docs``.

    Spans are whole matches in code points, ``kind:start:end`` in the order of start and then kind, comma-joined. The rules' spans all
    stay; the network adds ("net") the candidates that no rule's span overlaps and whose calibrated answer reaches the threshold of
    their shape. Null and empty texts have none. Repeated rows and rows without a key stay; an empty table gives an empty one.
    Columns of ``docs`` other than key and text aren't read, so their names may clash with any here. Every candidate of every whole
    text is read, in pieces of a MB, a longer text by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in pieces(rows_of(batch, "key", "text"), 1_000_000):
                found = _scanned([t.decode() for t in texts], net)
                counts = [[sum(s[0] == k for s in spans) for spans in found] for k in range(4)]
                base = [hashlib.sha256(_listed([s for s in spans if s[0] < 3]).encode()).hexdigest() for spans in found]
                columns = [pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(base), pa.array(list(map(_listed, found))), pa.array(counts[3], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_net"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(frugal(run), "key long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long")
    return out.withColumnRenamed("key", key)


def _scanned(texts: list[str], net: SecretNet | None) -> list[list[tuple[int, int, int]]]:
    """Spans of each text; the candidates of all of them go through the network together, with no characters between texts."""
    found = [base_spans(t) for t in texts]
    if net is None:
        return found
    rest, offset = [], 0  # (text's number, start, end, offset)
    for i, (t, spans) in enumerate(zip(texts, found, strict=True)):
        rest += [(i, a, b, offset) for a, b, hit in candidates(t, spans) if not hit]
        offset += len(t) + LEFT + RIGHT
    if not rest:
        return found
    own, start, end, before = (np.array(x, np.int64) for x in zip(*rest, strict=True))
    p = net.probability(net.logits(("\0" * (LEFT + RIGHT)).join(texts), start + before, end + before))
    likely = np.flatnonzero(p >= net.thresholds.min())
    for i, a, b, _ in (rest[r] for r in likely.tolist() if p[r] >= net.thresholds[shape_of(texts[rest[r][0]][rest[r][1] : rest[r][2]])]):
        found[i].append((3, a, b))
    for i in np.unique(own[likely]).tolist():
        found[i].sort(key=lambda s: (s[1], s[0]))
    return found


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, recall: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The secrets of every text (``secret_spans``) with a network fitted to ``findings``, by default to the rules' own in all of ``docs``."""
    if findings is None:
        findings = labelled_findings(docs, key, text)
    return secret_spans(docs, fit_secret_net(findings, recall), key, text)
