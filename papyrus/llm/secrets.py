"""Secret scans: fixed patterns, then a character convolutional network over every candidate in its context.

A candidate is a run of 12 or more of ``[A-Za-z0-9+/_.=-]`` with a digit and a letter in it. The network reads the
candidate's characters and 24 characters before and after it (numpy only): embedding, one convolution, maximum over the
places of candidate and context apart, mean over those of the candidate, and a logistic output; a long candidate is read by
windows that overlap by half, and its score is their maximum.

It is trained on findings that the patterns label: matches are secrets, candidates that no pattern touches are not, but for
those that networks trained without them take for secrets. The patterns say little of other secrets, so each secret is also
taken without its context, in the context of ordinary text, and redrawn: as a key of another length over another alphabet.
Clean ones are also made of the words of ordinary text as names, paths, hosts and versions look. All different rows of the corpus
are used; a third is held out for calibration, and the threshold is the highest one that still finds ``RECALL`` of the held-out
secrets of every such group. Up to ``UNIT_ROWS`` rows are learned from at once; more are dealt by hash to units of that size, in
``STAGES`` stages: the units of a stage start from the same network, each passes over its rows, and the mean of their networks
starts the next stage. Held-out rows are scored where they lie; what is summed up are counts of their scores. Every candidate of every
document is scored: those that reach beyond the patterns' spans become spans of their own, those within are counted as confirmed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from papyrus.llm.common import pick, shared_dir

# The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "network")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

CONTEXT, LENGTH = 24, 48
RECALL, ROUNDS = 0.95, 3
#: Rows that are learned from at once, stages of units, secrets (and others) that a unit should have at least, by copies if need be; scores are counted in steps of 1 / STEP.
UNIT_ROWS, STAGES, LEAST, STEP = 4500, 4, 500, 256
EMBED, WIDTH, FILTERS = 8, 5, 24
WINDOW = LENGTH + 2 * CONTEXT
REDRAWN = 300
#: Labels of training rows: a candidate that no pattern touches, a secret, ordinary text.
CLEAN, SECRET, PROSE = 0, 1, 2
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets that secrets are redrawn over.
ALPHABETS = (_LOWER + _UPPER + _DIGITS, _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "-_", "0123456789abcdef", "0123456789ABCDEF")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those too short dropped; by start, then kind as listed. Code points, end exclusive."""
    out, low = [], text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


def window(text: str, start: int, end: int) -> str:
    """CONTEXT characters, the at most LENGTH characters from start to end, CONTEXT characters; padded with \\0."""
    return text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0") + text[start:end].ljust(LENGTH, "\0") + text[end : end + CONTEXT].ljust(CONTEXT, "\0")


def windows(text: str, start: int, end: int) -> list[str]:
    """The whole of a candidate by windows of LENGTH characters, each half of the one before; the last ends with the candidate."""
    if end - start <= LENGTH:
        return [window(text, start, end)]
    return [window(text, at, at + LENGTH) for at in [*range(start, end - LENGTH, LENGTH // 2), end - LENGTH]]


def _codes(windows: list[str]) -> np.ndarray:
    """Character codes: 0 for padding, 1 to 95 for printable ASCII, 96 for other white space, 97 for the rest."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(windows), WINDOW).astype(np.int64)
    return np.select([raw == 0, (raw >= 32) & (raw < 127), raw < 32], [0, raw - 31, 96], 97)


class CharNet:
    """Embedding, convolution, two maxima (candidate, context) and a mean (candidate), logistic output; Adam; calibrated by Platt's two numbers."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "emb": rng.normal(0, 0.3, (98, EMBED)), "conv": rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.2, 3 * FILTERS), "b0": np.zeros(1),
        }
        self.p = {name: value.astype(np.float32) for name, value in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        #: Of each group of held-out findings: how many, and the share that is taken for secrets.
        self.report: dict[str, tuple[int, float]] = {}

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        padded = np.pad(codes, ((0, 0), (WIDTH // 2, WIDTH // 2)))
        places = np.lib.stride_tricks.sliding_window_view(padded, WIDTH, axis=1)
        x = self.p["emb"][places].reshape(len(codes), WINDOW, -1)
        act = np.maximum(x @ self.p["conv"] + self.p["bias"], 0)
        inner = np.zeros(WINDOW, bool)
        inner[CONTEXT : CONTEXT + LENGTH] = True
        tops = [np.where(m[None, :, None], act, -1.0).argmax(axis=1) for m in (inner, ~inner)]
        held = (inner & (codes > 0)).astype(np.float32)
        share = held / np.maximum(held.sum(axis=1), 1)[:, None]
        pooled = np.concatenate([*(np.take_along_axis(act, t[:, None, :], 1)[:, 0] for t in tops), np.einsum("np,npf->nf", share, act)], axis=1)
        return pooled @ self.p["out"] + self.p["b0"][0], (places, x, act, tops, share, pooled)

    def fit(self, codes: np.ndarray, truth: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """At least ``steps`` steps from the present parameters, and as many as it takes to pass over every row once."""
        rng, mean, square = np.random.default_rng(seed), {}, {}
        groups = [np.flatnonzero(truth == k) for k in (0, 1)]
        steps = max(steps, *(-(-len(g) // (batch // 2)) for g in groups))
        drawn = [np.concatenate([rng.permutation(g) for _ in range(-(-steps * (batch // 2) // len(g)))])[: steps * (batch // 2)].reshape(steps, -1) for g in groups]
        for step in range(1, steps + 1):
            pick_ = np.concatenate([d[step - 1] for d in drawn])
            logits, (places, x, act, tops, share, pooled) = self._forward(codes[pick_])
            d = ((1 / (1 + np.exp(-logits)) - truth[pick_]) / batch).astype(np.float32)
            grad = {"out": pooled.T @ d, "b0": np.array([d.sum()])}
            d_act = (d[:, None] * share)[:, :, None] * self.p["out"][2 * FILTERS :]
            for k, top in enumerate(tops):
                at = (np.arange(len(pick_))[:, None], top, np.arange(FILTERS)[None, :])
                d_act[at] += d[:, None] * self.p["out"][k * FILTERS : (k + 1) * FILTERS]
            d_act *= act > 0
            grad["bias"] = d_act.sum(axis=(0, 1))
            grad["conv"] = x.reshape(-1, WIDTH * EMBED).T @ d_act.reshape(-1, FILTERS)
            d_emb = (d_act @ self.p["conv"].T).reshape(-1, EMBED)
            grad["emb"] = np.stack([np.bincount(places.reshape(-1), d_emb[:, e], 98) for e in range(EMBED)], axis=1)
            for n, g in grad.items():
                mean[n] = 0.9 * mean.get(n, 0) + 0.1 * g
                square[n] = 0.999 * square.get(n, 0) + 0.001 * g * g
                self.p[n] = self.p[n] - rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, codes: np.ndarray, truth: np.ndarray, recall: float, others: Iterable[np.ndarray] = ()) -> None:
        """Platt scaling on held-out findings, then the highest threshold with that recall on their secrets and on each of the others."""
        logits = self.logits(codes)
        target = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
        for _ in range(500):
            d = 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30))) - target
            self.scale, self.shift = self.scale - 0.1 * float((d * logits).mean()), self.shift - 0.1 * float(d.mean())
        found = [np.sort(self.probability(c)) for c in (codes[truth == 1], *others) if len(c)]
        self.threshold = min((float(f[int((1 - recall) * len(f) + 1e-9)]) for f in found), default=0.5)

    def calibrate_counts(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], recall: float) -> None:
        """calibrate of held-out findings given as (ascending steps of 1 / STEP, how many logits are in each) of each group; the threshold is a step's lower end."""
        truth = {g: int(g not in ("clean", "look-alikes")) for g in counts}
        total = [sum(int(n.sum()) for g, (_, n) in counts.items() if truth[g] == k) for k in (0, 1)]
        logits, n = (np.concatenate(x) for x in ([(at + 0.5) / STEP for at, _ in counts.values()], [n for _, n in counts.values()]))
        target = np.concatenate([np.full(len(at), (total[1] + 1) / (total[1] + 2) if truth[g] else 1 / (total[0] + 2)) for g, (at, _) in counts.items()])
        for _ in range(500):
            d = (1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30))) - target) * (n / n.sum())
            self.scale, self.shift = self.scale - 0.1 * float((d * logits).sum()), self.shift - 0.1 * float(d.sum())
        found = {g: (1 / (1 + np.exp(-np.clip(self.scale * (at + (self.scale < 0)) / STEP + self.shift, -30, 30))), n) for g, (at, n) in counts.items()}
        lowest = []
        for p, n in (found[g] for g in counts if truth[g]):
            order = np.argsort(p, kind="stable")
            lowest.append(float(p[order][np.searchsorted(np.cumsum(n[order]), int((1 - recall) * n.sum() + 1e-9), "right")]))
        self.threshold = min(lowest, default=0.5)
        self.report = {g: (int(n.sum()), float(n[p >= self.threshold].sum() / n.sum())) for g, (p, n) in found.items()}

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = [self._forward(codes[lo : lo + 256])[0].astype(np.float64) for lo in range(0, len(codes), 256)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.shift, -30, 30)))

    def scores(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """The highest probability of each span's windows; the windows of a few hundred spans are held at a time."""
        out = []
        for lo in range(0, len(spans), 512):
            parts = [windows(text, *c) for c in spans[lo : lo + 512]]
            found = self.probability(_codes([w for p in parts for w in p]))
            out.append(np.maximum.reduceat(found, np.cumsum([0, *map(len, parts[:-1])])))
        return np.concatenate(out) if out else np.zeros(0)


def _union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans, sorted by start, cover together; both ascend."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _touches(span: tuple[int, int], union: tuple[list[int], list[int]]) -> bool:
    """Whether a character of span is covered."""
    k = bisect_right(union[1], span[0])  # the first part that ends after the span's start
    return k < len(union[0]) and union[0][k] < span[1]


def _covered(span: tuple[int, int], union: tuple[list[int], list[int]]) -> bool:
    """Whether every character of span is covered."""
    k = bisect_right(union[0], span[0]) - 1
    return k >= 0 and span[1] <= union[1][k]


def _prose(text: str) -> str | None:
    """A stretch of an ordinary text, at a place that its hash gives, as a window without a candidate in the middle."""
    if len(text) < WINDOW:
        return None
    at = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()) % (len(text) - WINDOW + 1)
    return text[at : at + WINDOW]


def _windows_of(text: str) -> Iterator[tuple[str, int]]:
    """(window, label) of what a text has to learn from."""
    spans = base_spans(text)
    union, found = _union(spans), candidates(text)
    for span in found:
        if not _touches(span, union):
            yield from ((w, CLEAN) for w in windows(text, *span))
    for kind, start, end in spans:
        if kind == "assign":
            start = _ASSIGN.match(text, start).start(2)
        inner = max(candidates(text[start:end]), key=lambda c: c[1] - c[0], default=None)
        if inner:
            yield from ((w, SECRET) for w in windows(text, start + inner[0], start + inner[1]))
    plain = None if spans or found else _prose(text)
    if plain:
        yield plain, PROSE


def findings(docs: DataFrame) -> DataFrame:
    """seen, label, h (hash), held (whether held out) and half of all different windows to learn from in docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(dict.fromkeys(x for text in batch.column(0).to_pylist() for x in _windows_of(text or "")))
            raw = [w.encode("utf-8", "surrogatepass") for w, _ in rows]
            digest = [_digest(w) for w, _ in rows]
            columns = ([w for w, _ in rows], [y for _, y in rows], [xxh64_intdigest(r) - (1 << 63) for r in raw], [d % 3 == 0 for d in digest], [d // 3 % 2 for d in digest])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int32()), strict=True)], ["seen", "label", "h", "held", "half"])

    return docs.select("text").mapInArrow(run, "seen string, label int, h long, held boolean, half int").dropDuplicates(["seen", "label"])


def labelled_findings(docs: DataFrame, most: int | None = None) -> list[tuple[str, int]]:
    """(window, label) of all different windows to learn from in docs (text); with ``most``, of each label only those with the smallest hashes. For small tables: they are collected."""
    found = findings(docs)
    for groups in (256, 16, 1) if most is not None else ():  # a task of the later rounds sees at most 16 * most rows
        place = F.row_number().over(Window.partitionBy("label", F.pmod("h", F.lit(groups))).orderBy("h", "seen"))
        found = found.withColumn("place", place).where(F.col("place") <= most).drop("place")
    return sorted((r["seen"], r["label"]) for r in found.select("seen", "label").collect())


def _digest(seen: str) -> int:
    return hashlib.blake2b(seen.encode("utf-8", "surrogatepass"), digest_size=2).digest()[0]


def _rng(seen: str, salt: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{salt}|{seen}".encode("utf-8", "surrogatepass"), digest_size=8).digest()))


def _placed(body: str, front: str, back: str) -> str:
    """A window with body in the middle, after front and before back (both CONTEXT characters)."""
    body = body[:LENGTH]
    return front + body.ljust(LENGTH, "\0") + back


def redrawn(seen: str, salt: int = 0) -> str:
    """A window's secret as a key of 16 to 48 characters over another alphabet, with a letter and a digit in it."""
    rng = _rng(seen, salt)
    letters = ALPHABETS[rng.integers(len(ALPHABETS))]
    while True:
        key = "".join(rng.choice(list(letters), rng.integers(16, LENGTH + 1)))
        if re.search("[0-9]", key) and re.search("[A-Za-z]", key):
            return _placed(key, seen[:CONTEXT], seen[CONTEXT + LENGTH :])


def lookalike(seen: str, salt: int = 0) -> str | None:
    """A candidate made of the words of a window as names, paths, hosts, dates and versions look; None without two words."""
    rng, words = _rng(seen, salt), re.findall("[A-Za-z]{2,}", seen)
    if len(words) < 2:
        return None
    some = [str(w) for w in rng.choice(words, 6)]
    n, year = int(rng.integers(0, 1000)), f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    many, sep = some[: int(rng.integers(2, 5))], str(rng.choice(["-", "_", ".", "/", ""]))
    shapes = (
        sep.join(many) + str(n), sep.join(w.title() for w in many) + str(n), f"{some[0]}.{n}{sep}{'.'.join(many)}.com", f"{n}.{some[0]}.{some[1]}.example.org", "/".join([*many, f"{some[4]}{n}"]),
        f"{'_'.join(many).upper()}_{n}", f"{year}T{rng.integers(0, 24):02d}", f"{year}-{'-'.join(many)}", f"{some[0]}-{n}.{rng.integers(0, 20)}.{rng.integers(0, 9)}.{some[1]}", f"{some[0].title()}{some[1].title()}{n}{some[2].title()}", "www." + "".join(many) + f"{n}.net/{some[4]}",
        some[0][:5].upper() + "".join(map(str, rng.integers(0, 10, rng.integers(8, 14)))), f"{some[0]}{sep}{rng.integers(10**6, 10**12)}",
    )
    body = shapes[rng.integers(len(shapes))]
    while len(body) < 12:
        body += sep + some[5]
    return _placed(body, seen[:CONTEXT], seen[CONTEXT + LENGTH :])


def _groups(rows: list[str], elsewhere: list[str], times: int | None = None) -> dict[str, list[str]]:
    """Secrets as they stand, in no context, in that of other windows, and redrawn in all three (REDRAWN each, or once each where they are more)."""
    none = "\0" * CONTEXT
    bare = [_placed(w[CONTEXT : CONTEXT + LENGTH], none, none) for w in rows]
    moved = [_placed(w[CONTEXT : CONTEXT + LENGTH], o[:CONTEXT], o[CONTEXT + LENGTH :]) for w, o in zip(rows, (elsewhere[k * 7919 % len(elsewhere)] for k in range(len(rows))), strict=True)]
    times = times or -(-REDRAWN // max(1, len(rows)))
    redrawn_ = {f"redrawn, {name}": [redrawn(w, 3 * copy + salt) for copy in range(times) for w in of] for salt, (name, of) in enumerate((("own context", rows), ("no context", bare), ("other context", moved)))}
    return {"own context": rows, "no context": bare, "other context": moved} | redrawn_


def _trained(rows: list[tuple[str, int]], held: np.ndarray, recall: float, steps: int = 400) -> CharNet:
    """A network fitted to the rows that are not held out and calibrated on the others."""
    part = {(label, out): [w for (w, y), h in zip(rows, held, strict=True) if y == label and bool(h) == out] for label in (CLEAN, SECRET, PROSE) for out in (False, True)}
    sets = []
    for out in (False, True):
        clean, prose = part[CLEAN, out], part[PROSE, out]
        made = [m for salt in range(3) for w in prose + clean for m in [lookalike(w, salt)] if m]
        secrets = _groups(part[SECRET, out], prose + clean or part[PROSE, False] + part[CLEAN, False])
        sets.append(({k: _codes(v) for k, v in secrets.items() if v}, {k: _codes(v) for k, v in {"clean": clean, "look-alikes": made}.items() if v}))
    (secrets, clean), (held_secrets, held_clean) = sets
    net = CharNet()
    x, y = [*secrets.values(), *clean.values()], [1] * len(secrets) + [0] * len(clean)
    net.fit(np.concatenate(x), np.repeat(y, [len(c) for c in x]), steps)
    x, y = [*held_secrets.values(), *held_clean.values()], [1] * len(held_secrets) + [0] * len(held_clean)
    net.calibrate(np.concatenate(x), np.repeat(y, [len(c) for c in x]), recall, held_secrets.values())
    net.report = {k: (len(c), float((net.probability(c) >= net.threshold).mean())) for k, c in {**held_secrets, **held_clean}.items()}
    return net


def train(findings: list[tuple[str, int]], recall: float = RECALL) -> CharNet | None:
    """A calibrated network; None where there are too few secrets or other windows to learn from and hold out.

    What no pattern touches may still be a secret. Two networks are each trained without half of these candidates; those to which
    the network that has not seen them gives an even chance are left out. This is done again as long as any are, ROUNDS times at most.
    """
    truth = np.array([y for _, y in findings], dtype=np.int64)
    if min((truth != SECRET).sum(), (truth == SECRET).sum()) < 12:
        return None
    digest = np.array([_digest(w) for w, _ in findings])
    rows, held, half = list(findings), digest % 3 == 0, digest // 3 % 2

    def enough(seen: np.ndarray) -> bool:
        return all(((truth[seen] == SECRET) == s).any() and (((truth[seen] == SECRET) == s) & ~held[seen]).any() and (((truth[seen] == SECRET) == s) & held[seen]).any() for s in (True, False))

    def keep(seen: np.ndarray) -> None:
        nonlocal rows, truth, held, half
        rows, truth, held, half = [r for r, s in zip(rows, seen, strict=True) if s], truth[seen], held[seen], half[seen]

    for _ in range(ROUNDS):
        likely = np.zeros(len(rows), bool)
        for k in (0, 1):
            seen, other = (truth != CLEAN) | (half == k), (truth == CLEAN) & (half != k)
            if other.any() and enough(seen):
                net = _trained([r for r, s in zip(rows, seen, strict=True) if s], held[seen], recall, 200)
                likely[other] = net.probability(_codes([r[0] for r, o in zip(rows, other, strict=True) if o])) >= 0.5
        if not likely.any() or not enough(~likely):
            break
        keep(~likely)
    return _trained(rows, held, recall) if enough(np.ones(len(rows), bool)) else None


class _Units:
    """Networks trained on rows (findings) that stay where Spark keeps them: a task sees one unit of about ``unit`` rows, the driver parameters and counts.

    Every row is in one unit; where a unit would have fewer than LEAST rows of a label, these are copied to several.
    """

    def __init__(self, rows: DataFrame, counts: dict[int, int], unit: int, recall: float) -> None:
        self.rows, self.recall = rows, recall
        self.units = STAGES * -(-sum(counts.values()) // (STAGES * unit))
        self.copies = {y: min(self.units, -(-self.units * LEAST // n)) for y, n in counts.items()}
        self.times = -(-REDRAWN // max(1, counts[SECRET] // 3))

    def _dealt(self, rows: DataFrame, halves: bool) -> DataFrame:
        """net, unit, copy, seen, label: one network (0), or two (0, 1), each of all secrets and a half of the others."""
        nets = F.when(F.col("label") == SECRET, F.array(F.lit(0), F.lit(1))).otherwise(F.array("half")) if halves else F.array(F.lit(0))
        copies = F.coalesce(*(F.when(F.col("label") == y, F.lit(n)) for y, n in self.copies.items()))
        rows = rows.withColumn("net", F.explode(nets)).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        return rows.select("net", F.pmod(F.pmod("h", F.lit(self.units)) + F.col("copy"), F.lit(self.units)).alias("unit"), "copy", "seen", "label").repartition(self.units, "net", "unit")

    def trained(self, halves: bool = False) -> list[CharNet]:
        """Fitted networks, calibrated on the held-out rows."""
        nets = [CharNet() for _ in range(1 + halves)]
        for stage in range(STAGES):
            start, rate = [n.p for n in nets], 0.01 * (1 - stage / STAGES)

            def fit(key: tuple, given: pa.Table) -> pa.Table:
                own, rows = key[0].as_py(), sorted(zip(given["seen"].to_pylist(), given["label"].to_pylist(), strict=True))
                net, part = CharNet(), {y: [w for w, label in rows if label == y] for y in (CLEAN, SECRET, PROSE)}
                net.p = dict(start[own])
                others = part[PROSE] + part[CLEAN]
                if part[SECRET] and others:
                    made = [m for w in others for m in [lookalike(w)] if m]
                    codes = [_codes([w for of in _groups(part[SECRET], others).values() for w in of]), _codes(others + made)]
                    net.fit(np.concatenate(codes), np.repeat([1, 0], [len(c) for c in codes]), 400 // STAGES, rate=rate)
                flat = np.concatenate([v.reshape(-1) for v in net.p.values()]).astype(float)
                return pa.table({"net": pa.array([own] * len(flat), pa.int32()), "place": pa.array(range(len(flat)), pa.int32()), "value": flat})

            dealt = self._dealt(self.rows.where(~F.col("held")), halves).where(F.col("unit") % STAGES == stage)
            fitted = dealt.groupBy("net", "unit").applyInArrow(fit, "net int, place int, value double")
            mean = fitted.groupBy("net", "place").agg(F.avg(F.col("value").cast("decimal(18,9)")).cast("double").alias("value"))  # decimals: the same in any order
            flat = {k: g.sort_values("place")["value"].to_numpy(np.float32) for k, g in mean.toPandas().groupby("net")}
            for k, values in flat.items():
                cuts = np.cumsum([v.size for v in nets[k].p.values()])[:-1]
                nets[k].p = {n: x.reshape(v.shape) for (n, v), x in zip(nets[k].p.items(), np.split(values, cuts), strict=True)}

        times = self.times

        def score(key: tuple, given: pa.Table) -> pa.Table:
            net, rows = key[0].as_py(), sorted(zip(*(given[n].to_pylist() for n in ("label", "seen", "copy")), strict=True))
            others, plain = [w for y, w, _ in rows if y != SECRET], [w for y, w, copy in rows if y != SECRET and not copy]
            own = {y: [w for label, w, copy in rows if label == y and not copy] for y in (CLEAN, SECRET)}
            groups = (_groups(own[SECRET], others or own[SECRET], times) if own[SECRET] else {}) | {"clean": own[CLEAN], "look-alikes": [m for w in plain for m in [lookalike(w)] if m]}
            out = []
            for name, of in groups.items():
                if of:
                    at, n = np.unique(np.floor(np.clip(nets[net].logits(_codes(of)), -60, 60) * STEP).astype(np.int64), return_counts=True)
                    out += [(net, name, int(x), int(k)) for x, k in zip(at, n, strict=True)]
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["net", "name", "at", "n"])

        scored = self._dealt(self.rows.where("held"), halves).groupBy("net", "unit").applyInArrow(score, "net int, name string, at long, n long")
        for k, counts in scored.groupBy("net", "name", "at").agg(F.sum("n").alias("n")).toPandas().groupby("net"):
            nets[k].calibrate_counts({name: (g["at"].to_numpy(), g["n"].to_numpy()) for name, g in counts.sort_values(["name", "at"]).groupby("name")}, self.recall)
        return nets


def train_on(docs: DataFrame, recall: float = RECALL, unit: int = UNIT_ROWS) -> CharNet | None:
    """train on all findings of docs (text), by units where they are more than ``unit`` rows."""
    spark, base = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/findings-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{base}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{base}/{name}")

    def counted(rows: DataFrame) -> tuple[dict[int, int], bool, bool]:
        """Rows by label; whether secrets and others can be learned from and held out; whether also by each half of the others."""
        seen = [tuple(r) for r in rows.groupBy("label", "held", "half").count().collect()]
        labels = {y: sum(n for label, _, _, n in seen if label == y) for y in sorted({r[0] for r in seen})}
        each = {(y == SECRET, held) for y, held, _, _ in seen}
        halves = {(held, half) for y, held, half, _ in seen if y != SECRET}
        return labels, len(each) == 4, len(each) == 4 and len(halves) == 4

    rows = kept(findings(docs), "all")
    labels, enough, halves = counted(rows)
    if sum(labels.values()) <= unit:
        return train(sorted((r["seen"], r["label"]) for r in rows.select("seen", "label").collect()), recall)
    if min(labels.get(SECRET, 0), sum(labels.values()) - labels.get(SECRET, 0)) < 12 or not enough:
        return None
    fixed, clean = rows.where(F.col("label") != CLEAN), rows.where(F.col("label") == CLEAN)
    for turn in range(ROUNDS):
        if not labels.get(CLEAN) or not halves:
            break
        nets = _Units(fixed.unionByName(clean), labels, unit, recall).trained(halves=True)

        def unlikely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, half = _codes(batch.column(0).to_pylist()), batch.column(4).to_numpy()
                yield batch.filter(pa.array(np.where(half == 0, nets[1].probability(codes), nets[0].probability(codes)) < 0.5))

        left = kept(clean.mapInArrow(unlikely, clean.schema), f"clean-{turn}")
        now, enough, halves = counted(fixed.unionByName(left))
        if now == labels or not enough:
            break
        clean, labels = left, now
    return _Units(fixed.unionByName(clean), labels, unit, recall).trained()[0]


def find_spans(text: str, net: CharNet | None) -> tuple[list[Span], int]:
    """All spans by start, then kind, and how many candidates within the patterns' spans the network confirms.

    All are the patterns' spans and, of kind network, candidates that reach beyond those and have a window that scores over the threshold.
    """
    spans = base_spans(text)
    found = candidates(text) if net else []
    if not found:
        return spans, 0
    said, union = net.scores(text, found) >= net.threshold, _union(spans)
    inside = np.array([_covered(c, union) for c in found])
    more = [("network", *c) for c, yes in zip(found, said & ~inside, strict=True) if yes]
    return sorted(spans + more, key=lambda s: (s[1], KINDS.index(s[0]))), int((said & inside).sum())


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """text with every run of overlapping spans replaced by mask."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, unit: int = UNIT_ROWS, with_masked: bool = True) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network, n_confirmed, network and masked (the text without its secrets; null if not asked for) for every row of df.

    Null texts count as empty. Where the corpus has too few different findings to train on, only the patterns give spans, and network is
    false. The network is trained when this is called: by Spark, or in the driver where the findings are no more than ``unit``.
    """
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    net = train_on(docs, recall, unit)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network", "n_confirmed", "network", "masked"]
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans, confirmed = find_spans(text or "", net)
                kinds = [s[0] for s in spans]
                base = hashlib.sha256(join_spans([s for s in spans if s[0] != "network"]).encode()).hexdigest()
                rows.append((doc, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), base, join_spans(spans), kinds.count("network"), confirmed, net is not None, masked(text or "", spans) if with_masked else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), types, strict=True)], names)

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long, n_confirmed long, network boolean, masked string")


def mask_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", recall: float = RECALL, unit: int = UNIT_ROWS) -> DataFrame:
    """df, all rows and columns, with the secrets of the text masked and its length (if there is such a column) brought up to date; null texts stay null."""
    net = train_on(df.select(F.col(f"`{text_col}`").alias("text")), recall, unit)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else masked(t, find_spans(t, net)[0]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = df.mapInArrow(run, df.schema)
    if length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.col(f"`{text_col}`").isNotNull(), F.length(f"`{text_col}`")).cast(df.schema[length_col].dataType))
    return out
