"""Secret scans: fixed patterns, and a character convolutional network over every further candidate and its context.

The network is a small numpy model (one convolution over character classes, maximum and mean pooling, a logistic output). It is trained on labelled findings
from a bounded sample of the documents themselves: their candidates, which the fixed patterns label, and made-up credentials and other long tokens that are
planted in their texts. Its scores are calibrated on documents held out, and each shape of candidate has a threshold that keeps the required
recall there, or a lower one that few other tokens reach. Candidates are read whole, long ones by overlapping windows. Spans of the patterns are always reported; the network adds spans of kind model that
overlap none of them.

Offsets are code points, ends exclusive. Null texts count as empty and have no spans; documents without an id are scanned but not sampled. Texts are scanned
whole. Repeated rows are reported each. An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspan.llm.shared import bounded_sample

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Further candidates: every long run of characters that credentials are made of.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
#: Characters around a candidate; a longer candidate is read by overlapping windows of so many characters over all of it.
CONTEXT, WINDOW, WIDTH, FILTERS = 20, 48, 5, 16
#: Documents that findings are drawn from, and findings that the network is fitted on, at most.
SAMPLE_DOCS, SAMPLE_FINDINGS = 8_000, 8_000
#: Windows that are scored together; characters of the texts that are scanned together, about.
SCORED, PART_CHARS = 256, 1_000_000
#: Share of held-out credentials that each threshold keeps at least; of other tokens that may reach it, if that needn't cost credentials.
RECALL, FALSE = 0.97, 0.005


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = []
    if any(w in text.lower() for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover a candidate."""
    if end - start <= WINDOW:
        return [(start, end)]
    half = WINDOW // 2
    return [(i, i + WINDOW) for i in range(start, end - WINDOW, half)] + [(end - WINDOW, end)]


def _shape(token: str) -> int:
    """0: hexadecimal digits and separators; 1: letters of one case; 2: both cases."""
    if re.fullmatch(r"[0-9a-fA-F_=/+.-]+", token):
        return 0
    return 2 if re.search("[a-z]", token) and re.search("[A-Z]", token) else 1


def _channel_table() -> np.ndarray:
    table = np.zeros((129, 13), dtype=np.float32)  # row 128: any other character
    for c in range(128):
        ch = chr(c)
        table[c, 0] = ch in "aeiou"
        table[c, 1] = ch.islower() and ch not in "aeiou"
        table[c, 2] = ch.isupper() and ch in "AEIOU"
        table[c, 3] = ch.isupper() and ch not in "AEIOU"
        table[c, 4] = ch.isdigit()
        table[c, 5] = ch in "abcdefABCDEF"
        table[c, 6] = ch in "+/"
        table[c, 7] = ch in "-_"
        table[c, 8] = ch in "=:"
        table[c, 9] = ch in "\"'`"
        table[c, 10] = ch in " \t\n"
        table[c, 11] = ch in ".,;?!()@"
    table[128, 11] = 1
    return table


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Channels of a window and its context; the last channel marks the window."""
    token = text[start:end]
    left, right = text[max(0, start - CONTEXT) : start].rjust(CONTEXT), text[end : end + CONTEXT].ljust(CONTEXT)
    codes = np.minimum(np.frombuffer((left + token + right).encode("utf-32-le", "replace"), dtype="<u4"), 128)
    x = np.zeros((2 * CONTEXT + WINDOW, 13), dtype=np.float32)
    x[: len(codes)] = _CHANNELS[codes]
    x[CONTEXT : CONTEXT + len(token), 12] = 1
    return x


_CHANNELS = _channel_table()


class CharNet:
    """Convolution, rectifier, maximum and mean pooling, logistic output; trained by Adam."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"k": rng.normal(0, 0.2, (WIDTH * 13, FILTERS)), "kb": np.zeros(FILTERS), "w": rng.normal(0, 0.2, 2 * FILTERS), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.thresholds = 1.0, 0.0, [0.5, 0.5, 0.5]

    @staticmethod
    def _windows(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[:, i : x.shape[1] - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)

    def _forward(self, x: np.ndarray):
        cols = self._windows(x)
        h = np.maximum(cols @ self.p["k"] + self.p["kb"], 0)
        top = h.argmax(axis=1)
        share = self._share(x)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None, :], 1)[:, 0], (h * share).sum(axis=1)], axis=1)
        return cols, h, top, share, pooled, pooled @ self.p["w"] + self.p["b"]

    @staticmethod
    def _share(x: np.ndarray) -> np.ndarray:
        """Weights of the mean over the places of the window itself, without its context."""
        own = x[:, WIDTH // 2 : x.shape[1] - WIDTH // 2, 12:13]
        return own / np.maximum(own.sum(axis=1, keepdims=True), 1)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, rate: float = 4e-3, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), 64):
                at = order[i : i + 64]
                cols, h, top, share, pooled, z = self._forward(x[at])
                dz = ((1 / (1 + np.exp(-z)) - y[at]) / len(at)).astype(np.float32)
                dp = dz[:, None] * self.p["w"]
                dh = dp[:, None, FILTERS:] * share
                np.put_along_axis(dh, top[:, None, :], np.take_along_axis(dh, top[:, None, :], 1) + dp[:, None, :FILTERS], 1)
                dh *= h > 0
                grad = {"k": cols.reshape(-1, cols.shape[2]).T @ dh.reshape(-1, FILTERS), "kb": dh.sum(axis=(0, 1)), "w": pooled.T @ dz, "b": np.array([dz.sum()])}
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, shapes: np.ndarray, recall: float) -> None:
        """Platt scaling, then for each shape a threshold with this recall: as low as the other tokens let it be, and from 0.5 on, but never above the highest one that keeps the recall. A shape without
        positives gets that of all together."""
        z = self._forward(x)[-1]
        for _ in range(500):
            g = 1 / (1 + np.exp(-(self.scale * z + self.shift))) - y
            self.scale -= 0.05 * float((g * z).mean())
            self.shift -= 0.05 * float(g.mean())
        s = self.scores(x)
        for k in range(3):
            own = np.sort(s[(shapes == k) & (y > 0.5)])
            own = own if len(own) else np.sort(s[y > 0.5])
            if len(own):
                other = s[(shapes == k) & (y <= 0.5)]
                fine = max(0.5, float(np.quantile(other, 1 - FALSE)) + 1e-6 if len(other) else 0.5)
                self.thresholds[k] = min(fine, float(own[int((1 - recall) * len(own))]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self._forward(x)[-1] + self.shift)))


def made_up(rng: np.random.Generator, label: int) -> tuple[str, int, int]:
    """(token, start, end): a credential of a common shape, or another long token. start and end: the part that is secret."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def draw(alphabet: str, a: int, b: int) -> str:
        return "".join(rng.choice(list(alphabet), int(rng.integers(a, b))))

    def word() -> str:
        ends = pick("", "", "n", "r", "st", "ng", "ck", "ll", "ty", "x", "s")
        return "".join(draw("bcdfghjklmnpqrstvwxz", 1, 3) + draw("aeiouy", 1, 3) for _ in range(int(rng.integers(1, 5)))) + ends

    def pick(*x):
        return x[int(rng.integers(len(x)))]

    if label:
        makers = (
            lambda: draw(low + up + dig, 20, 64),
            lambda: draw(low + up + dig + "+/", 30, 80) + pick("", "=", "=="),
            lambda: pick("ghp_", "gho_", "sk_live_", "pk_test_", "glpat-", "npm_") + draw(low + up + dig, 20, 40),
            lambda: pick("xoxb-", "xoxp-") + draw(dig, 10, 13) + "-" + draw(low + up + dig, 20, 30),
            lambda: pick("xoxb-", "key-", "tok_") + draw(dig, 8, 13) + "-" + draw(low, 4, 9) + draw(up, 4, 9) + draw(dig, 6, 12),
            lambda: draw("0123456789ABCDEF", 32, 64),
            lambda: "eyJ" + draw(low + up + dig + "-_", 30, 90) + "." + draw(low + up + dig + "-_", 20, 40),
            lambda: draw(low + dig, 24, 50),
            lambda: draw(up + dig, 20, 40),
        )
        token = makers[int(rng.integers(len(makers)))]()
        before = f"/{word()}/v{draw(dig, 1, 2)}/{word()}s/" if rng.random() < 0.15 else ""
        behind = f"/{word()}/{word()}-{word()}" if before else ""
        return before + token + behind, len(before), len(before) + len(token)
    makers = (
        lambda: "-".join(word() for _ in range(4)) + "-" + draw(dig, 1, 5),
        lambda: "_".join(word() for _ in range(4)) + draw(dig, 1, 3),
        lambda: f"20{draw(dig, 2, 3)}-{draw('01', 1, 2)}{draw(dig, 1, 2)}-{draw('012', 1, 2)}{draw(dig, 1, 2)}T{draw(dig, 6, 9)}",
        lambda: "/".join(word() for _ in range(4)) + "/v" + draw(dig, 1, 3),
        lambda: "".join(word() for _ in range(4)).ljust(12, "a") + draw(dig, 1, 4),
        lambda: "".join(word().capitalize() for _ in range(4)) + "Handler" + draw(dig, 1, 3),
        lambda: pick("ISBN", "DOI", "PO", "ID", "Tel") + "-" + "-".join(draw(dig, 3, 5) for _ in range(4)),
        lambda: draw(dig, 12, 20),
        lambda: "_".join(word().upper() for _ in range(3)) + pick("", "_" + draw(dig, 2, 5)),
        lambda: pick("_", "-", "/", ".").join(word().upper() for _ in range(int(rng.integers(2, 6)))).ljust(12, "A"),
        lambda: "-".join(draw("0123456789abcdef", n, n + 1) for n in (8, 4, 4, 4, 12)),
        lambda: ".".join(word() for _ in range(4)) + pick(".com", ".html", ".py", ".org/" + word()),
        lambda: "".join(word() for _ in range(5)).ljust(12, "a"),
    )
    token = makers[int(rng.integers(len(makers)))]()
    return token, 0, len(token)


def findings_in(text: str, rng: np.random.Generator, most: int = 6) -> list[tuple[str, int, int, int, bool]]:
    """(window with context, start, end, label, planted) from one document.

    The document's own candidates are labelled by the fixed patterns: what these find is a credential, other candidates aren't. Besides, made-up
    credentials and other tokens are planted at white space of the document, since the patterns know a few shapes only.
    """
    out = []

    def add(t: str, a: int, b: int, label: int, planted: bool) -> None:
        first = max(0, a - CONTEXT)
        out.append((t[first : b + CONTEXT], a - first, b - first, label, planted))

    base = base_spans(text)
    own = [w + (int(any(s < w[1] and e > w[0] for s, _, e in base)),) for c in candidates(text) for w in windows(*c)]
    for label, n in ((1, most), (0, 2)):
        some = [w for w in own if w[2] == label]
        for i in rng.permutation(len(some))[:n]:
            add(text, *some[i], False)
    for label in (0, 1, 0, 1, 0, 1):
        token, a, b = made_up(rng, label)
        leads = ("", "key = ", "auth: ", '"', "use ", "bearer ", "credential=") if label else ("", "see ", "in ", "(", "file ", "id: ", "ref=")
        gaps = [m.start() for m in re.finditer(" ", text[:20_000])] or [0]
        at = gaps[int(rng.integers(len(gaps)))]
        # a third of them begins the text, a third ends it
        # and half of them has no word that leads to it, so that it is told by itself
        left = (text[max(0, at - 60) : at] + " " if rng.random() > 0.33 else "") + (leads[int(rng.integers(len(leads)))] if rng.random() > 0.5 else "")
        behind = (" ", '" ', ". ", "\n", ") ")[int(rng.integers(5))] + text[at : at + 60]
        whole = left + token + (behind if rng.random() > 0.33 else "")
        a, b = a + len(left), b + len(left)
        # a window is a credential where seven tenths of it are so, or the whole credential lies in it
        for x, y in [w for c in candidates(whole) if c[0] < len(left) + len(token) and c[1] > len(left) for w in windows(*c)]:
            inside = min(y, b) - max(x, a)
            if not label or inside >= min(0.7 * (y - x), b - a):
                add(whole, x, y, label, True)
    return out


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out += [(doc_id, *f) for f in findings_in(text or "", np.random.default_rng(doc_id & 0xFFFFFFFF))]
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "text", "start", "end", "label", "planted"])


def labelled_findings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_findings: int = SAMPLE_FINDINGS) -> DataFrame:
    """(doc_id, text, start, end, label, planted), at most sample_findings rows from at most sample_docs documents. Credentials found by the patterns
    come first, then planted ones, so that plain words don't crowd them out."""
    slim = bounded_sample(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", sample_docs)
    each = slim.mapInArrow(_drawn, "doc_id long, text string, start int, end int, label int, planted boolean")
    rank = F.row_number().over(Window.partitionBy("label", "planted").orderBy(F.xxhash64("doc_id", "text", "start"), "doc_id", "text", "start"))
    return each.withColumn("rank", rank).where(F.col("rank") <= sample_findings // 4).drop("rank")


def fit_net(findings: pd.DataFrame, recall: float = RECALL) -> CharNet:
    """The network trained on seven tenths of the documents of these findings and calibrated on the others."""
    net = CharNet()
    if not len(findings):
        net.thresholds = [2.0] * 3  # nothing to learn from: no candidate is a finding
        return net
    rows = findings.sort_values(["doc_id", "text", "start", "label"]).reset_index(drop=True)
    x = np.stack([encoded(t, a, b) for t, a, b in zip(rows["text"], rows["start"], rows["end"], strict=True)])
    y = rows["label"].to_numpy(np.float64)
    shapes = np.array([_shape(t[a:b]) for t, a, b in zip(rows["text"], rows["start"], rows["end"], strict=True)])
    held = np.array([hashlib.md5(str(d).encode()).digest()[0] % 10 >= 7 for d in rows["doc_id"]])
    if held.all() or not held.any():
        held = np.arange(len(rows)) % 10 >= 7
    net.train(x[~held], y[~held])
    net.calibrate(x[held], y[held], shapes[held], recall)
    return net


def find_spans(text: str, net: CharNet) -> list[tuple[int, int, int]]:
    return find_all_spans([text], net)[0]


def find_all_spans(texts: list[str], net: CharNet) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text, sorted: all spans of the patterns, and of candidates that overlap none of these the stretches whose windows reach their threshold. Windows of all texts
    are scored together."""
    out, asked = [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        open_end, k = 0, 0
        for a, b in candidates(text):
            while k < len(base) and base[k][0] < b:
                open_end = max(open_end, base[k][2])
                k += 1
            if open_end <= a:
                asked += [(i, a, w) for w in windows(a, b)]
        out.append(base)
    added: list[tuple[int, int, int, int]] = []  # text, start of the candidate, start, end
    for at in range(0, len(asked), SCORED):
        part = asked[at : at + SCORED]
        scores = net.scores(np.stack([encoded(texts[i], *w) for i, _, w in part]))
        least = np.array([net.thresholds[_shape(texts[i][w[0] : w[1]])] for i, _, w in part])
        for n in np.flatnonzero(scores >= least).tolist():
            i, a, w = part[n]
            if added and added[-1][:2] == (i, a) and added[-1][3] >= w[0]:
                added[-1] = (*added[-1][:3], w[1])
            else:
                added.append((i, a, *w))
    for i, _, s, e in added:
        out[i].append((s, 3, e))
    return [sorted(o) for o in out]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _by_parts(texts: list[str], net: CharNet) -> Iterator[list[tuple[int, int, int]]]:
    """Spans of texts, of a bounded number of characters at a time."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n > PART_CHARS:
            yield from find_all_spans(part, net)
            part, n = [], 0
    yield from find_all_spans(part, net)


def _scanned(net: CharNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, joined = [[], [], [], []], [], []
            for spans in _by_parts([t or "" for t in batch.column(1).to_pylist()], net):
                for k in range(4):
                    counts[k].append(sum(1 for s in spans if s[1] == k))
                digests.append(hashlib.sha256(_joined([s for s in spans if s[1] < 3]).encode()).hexdigest())
                joined.append(_joined(spans))
            cols = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans of each row of docs (doc_id, text). Without a network, one is fitted on docs."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    net = net or fit_net(labelled_findings(slim).toPandas())
    return slim.mapInArrow(_scanned(net), "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
