"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a whole text, white space included, in both directions and gives a distribution over the
languages at every position. A document's probabilities are the mean over all its positions. Texts are read in stretches
of STRETCH bytes; each direction first reads the CONTEXT bytes beyond the stretch without labelling them, so its state
has crossed words and the edges of stretches, and a character cut by an edge is read whole. It is trained in numpy by
backpropagation through time with Adam; the steps of the context are part of it.

The training sample is bounded by rows: at most `docs_per_label` labelled documents of each label, chosen by a hash among
those of at most `longest_doc` bytes, each with its whole text. Prediction runs in Arrow batches over whole texts of any
length, some hundred kilobytes at a time.

Defined results: null texts and texts without a letter are `und` with score 0; an empty table gives an empty result;
rows that repeat are predicted alike; ties go to the label that sorts first; without any labelled row all is `und`;
own columns named lang_pred and score give way to the new ones. A very long text is read stretch by stretch like any
other: about ten bytes of memory a byte of it, for one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import small_or_shuffled, stored
from quillspark.llm.textnp import _LOWER, tidy

#: Bytes that are labelled at a time, and bytes read before them on either side.
STRETCH, CONTEXT = 112, 16
#: Stretches that the network reads side by side, and bytes of text cut into stretches at a time.
SIDE_BY_SIDE, TEXT_AT_ONCE = 1024, 1 << 18
UND = "und"
#: Rows of an Arrow batch that are answered at a time, so that few texts are held twice.
ROWS_AT_ONCE = 256


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in lower case (A-Z) with CONTEXT zeros before each and after the last, the starts and lengths of their
    stretches, and the first stretch of each text (plus the end)."""
    gap = bytes(CONTEXT)
    buf = _LOWER[np.frombuffer(gap + gap.join(texts) + gap, np.uint8)]
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + CONTEXT) - size
    n = -(-size // STRETCH)
    first = np.concatenate([[0], np.cumsum(n)])
    which = np.arange(first[-1]) - np.repeat(first[:-1], n)
    begin = np.repeat(start, n) + which * STRETCH
    return buf, begin, np.minimum(np.repeat(start + size, n) - begin, STRETCH), first


class BiGRU:
    """Parameters by name. w: input rows by byte (the one-hot product), u: recurrent, v: output, c: output bias. The
    columns of w and u are those of the update gate, the reset gate and the candidate."""

    def __init__(self, labels: list[str], hidden: int = 16, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        scale = 1 / np.sqrt(hidden)
        self.p: dict[str, np.ndarray] = {"c": np.zeros(len(labels), np.float32)}
        for way in "fb":
            self.p[f"w{way}"] = draw.normal(0, scale, (256, 3 * hidden)).astype(np.float32)
            self.p[f"u{way}"] = draw.normal(0, scale, (hidden, 3 * hidden)).astype(np.float32)
            self.p[f"v{way}"] = draw.normal(0, scale, (hidden, len(labels))).astype(np.float32)

    # The stretches of a batch are in order of falling length, so those that a position concerns are the first ones:
    # `read` of them have it among their bytes or context, `own` of them label it. Both ways go by the same positions.

    @staticmethod
    def _steps(way: str, length: np.ndarray) -> list[tuple[int, int, int]]:
        """(position, read, own) in the order in which a way reads."""
        own = lambda at: int(np.searchsorted(-length, -at))  # noqa: E731 how many are longer than that
        longest = int(length[0])
        if way == "f":
            return [(at, len(length) if at < 0 else own(at), own(at) if at >= 0 else 0) for at in range(-CONTEXT, longest)]
        return [(at, own(at - CONTEXT) if at >= CONTEXT else len(length), own(at)) for at in range(longest + CONTEXT - 1, -1, -1)]

    def _run(self, way: str, buf: np.ndarray, begin: np.ndarray, length: np.ndarray, logits: np.ndarray, memory: list | None = None) -> None:
        """Adds the way's share to logits (label, position, stretch). All arrays have the stretches in their rows'
        direction, so that numpy runs along them."""
        k, v = self.hidden, np.ascontiguousarray(self.p[f"v{way}"].T)
        # a gate is (1 + tanh(x / 2)) / 2, so its share of w and u is halved once for all bytes
        half = np.concatenate([np.full(2 * k, 0.5, np.float32), np.ones(k, np.float32)])
        w, u = (np.ascontiguousarray((self.p[f"{name}{way}"] * half).T) for name in "wu")
        state = np.zeros((k, len(begin)), w.dtype)
        room = np.empty(w.shape[0] * len(begin), w.dtype)
        for at, n, own in self._steps(way, length):
            x = np.take(w, buf[begin[:n] + at], axis=1, out=room[: len(w) * n].reshape(len(w), n), mode="clip")
            old = state[:, :n]
            g = u @ old
            gates = g[: 2 * k]
            gates += x[: 2 * k]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:k], gates[k:]
            cand = r * g[2 * k :]
            cand += x[2 * k :]
            np.tanh(cand, out=cand)
            if memory is not None:
                memory.append((old.copy(), z, r, cand, g[2 * k :]))
            old -= cand
            old *= z
            old += cand
            if own:
                logits[:, at, :own] += v @ state[:, :own]

    def _back(self, way: str, buf: np.ndarray, begin: np.ndarray, length: np.ndarray, memory: list, dlogits: np.ndarray) -> dict[str, np.ndarray]:
        u, v, k = self.p[f"u{way}"], self.p[f"v{way}"], self.hidden
        dstate, du, dv = np.zeros((k, len(begin)), u.dtype), np.zeros_like(u), np.zeros_like(v)
        rows, grads = [], []
        for (at, n, own), (old, z, r, cand, gc) in zip(reversed(self._steps(way, length)), reversed(memory), strict=True):
            dnew = dstate[:, :n]
            if own:
                dl = dlogits[:, at, :own]
                dv += (cand + z * (old - cand))[:, :own] @ dl.T
                dnew[:, :own] += v @ dl
            dcand = dnew * (1 - z) * (1 - cand * cand)
            dz = dnew * (old - cand) * z * (1 - z)
            dr = dcand * gc * r * (1 - r)
            dg = np.concatenate([dz, dr, dcand * r])
            du += old @ dg.T
            dstate[:, :n] = dnew * z + u @ dg
            rows.append(buf[begin[:n] + at])
            grads.append(np.concatenate([dz, dr, dcand]).T)
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        order = np.argsort(rows, kind="stable")
        rows, grads = rows[order], grads[order]
        edge = np.flatnonzero(np.diff(rows.astype(np.int32), prepend=-1))
        dw = np.zeros_like(self.p[f"w{way}"])
        dw[rows[edge]] = np.add.reduceat(grads, edge, axis=0)
        return {f"w{way}": dw, f"u{way}": du, f"v{way}": dv}

    def _probabilities(self, buf, begin, length, memories=(None, None)) -> tuple[np.ndarray, np.ndarray]:
        """Distributions by label, position and stretch, and which positions are in their stretch."""
        p = np.empty((len(self.labels), int(length[0]), len(begin)), self.p["c"].dtype)
        p[:] = self.p["c"][:, None, None]
        for way, memory in zip("fb", memories, strict=True):
            self._run(way, buf, begin, length, p, memory)
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p, np.arange(p.shape[1])[:, None] < length

    def stretch_sums(self, buf: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Per stretch the probabilities summed over its positions."""
        out = np.zeros((len(begin), len(self.labels)), np.float32)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), SIDE_BY_SIDE):
            at = order[i : i + SIDE_BY_SIDE]
            p, used = self._probabilities(buf, begin[at], length[at])
            p *= used
            out[at] = p.sum(1).T
        return out

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Per text the mean over its positions; zeros for an empty text."""
        out = np.zeros((len(texts), len(self.labels)))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < TEXT_AT_ONCE):
                size += len(texts[j])
                j += 1
            buf, begin, length, first = stretches(texts[i:j])
            full = first[:-1] < first[1:]
            if full.any():
                sums = np.add.reduceat(self.stretch_sums(buf, begin, length).astype(np.float64), first[:-1][full], axis=0)
                out[i:j][full] = sums / np.add.reduceat(length, first[:-1][full])[:, None]
            i = j
        return out

    def gradients(self, buf: np.ndarray, begin: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss over all positions and its gradient by parameter."""
        order = np.argsort(-length, kind="stable")
        begin, length, label = begin[order], length[order], label[order]
        memories: tuple[list, list] = ([], [])
        p, used = self._probabilities(buf, begin, length, memories)
        total, column = float(used.sum()), np.arange(len(label))
        loss = -np.log(p[label, :, column] + 1e-9)[used.T].sum() / total
        p[label, :, column] -= 1
        p *= used / p.dtype.type(total)
        grads = {"c": p.sum((1, 2))}
        for way, memory in zip("fb", memories, strict=True):
            grads |= self._back(way, buf, begin, length, memory, p)
        return loss, grads

    def fit(self, buf, begin, length, label, epochs: int = 3, batch: int = 96, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam; the mean loss of each epoch."""
        draw = np.random.default_rng(seed)
        first = {n: np.zeros_like(x) for n, x in self.p.items()}
        second = {n: np.zeros_like(x) for n, x in self.p.items()}
        losses, step, steps = [], 0, epochs * max(1, -(-len(label) // batch))
        for _ in range(epochs):
            order, losses_now = draw.permutation(len(label)), []
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                loss, grads = self.gradients(buf, begin[at], length[at], label[at])
                step += 1
                now = rate * (1 - (step - 1) / steps)
                for n, g in grads.items():
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.001 * (g * g - second[n])
                    self.p[n] -= (now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                losses_now.append(loss)
            losses.append(float(np.mean(losses_now)))
        return losses


def training_texts(labelled: DataFrame, docs_per_label: int = 160, longest_doc: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """The bounded sample: whole texts and their labels."""
    place = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    chosen = Window.partitionBy("label").orderBy("place")
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.octet_length(text_col) <= longest_doc))
    rows = rows.select(F.col(label_col).cast("string").alias("label"), place.alias("place"), F.col(text_col).alias("text"))
    # the texts take no part in finding the smallest places, so nothing long is sorted; they are looked up afterwards
    places = rows.select("label", "place").withColumn("n", F.row_number().over(chosen)).filter(F.col("n") <= docs_per_label)
    places = small_or_shuffled(stored(places.select("label", "place").distinct()))
    rows = rows.join(places, ["label", "place"], "left_semi").dropDuplicates(["label", "place"])
    found = rows.toArrow().sort_by([("label", "ascending"), ("place", "ascending")])
    return [t.encode() for t in found.column("text").to_pylist()], found.column("label").to_pylist()


def train(labelled: DataFrame, hidden: int = 16, epochs: int = 3, **sample) -> BiGRU | None:
    texts, said = training_texts(labelled, **sample)
    if not texts:
        return None
    net = BiGRU(sorted(set(said)), hidden)
    buf, begin, length, first = stretches(texts)
    label = np.repeat([net.labels.index(x) for x in said], np.diff(first))
    net.fit(buf, begin, length, label, epochs)
    return net


def predict(docs: DataFrame, net: BiGRU | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; own columns of those names give way."""
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = docs.select(*own).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):  # slices share the batch's memory
                yield answered(batch.slice(start, ROWS_AT_ONCE))

    def answered(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spoken = (batch.column(i).to_pylist() for i in (text_at, len(batch.columns) - 1))
        tags, scores = [UND] * len(texts), [0.0] * len(texts)
        at = [i for i, x in enumerate(spoken) if x] if net else []
        if at:
            p = net.document_probabilities([texts[i].encode() for i in at])
            best = p.argmax(1)
            for i, k, s in zip(at, best.tolist(), p.max(1).tolist(), strict=True):
                tags[i], scores[i] = net.labels[k], min(1.0, round(s, 6))
        kept = [batch.column(i) for i in range(len(own))]
        return pa.RecordBatch.from_arrays([*kept, pa.array(tags, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])

    spoken = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__spoken")
    # the text goes to Python once: as a column of its own only where it isn't among those returned
    named = [i for i, c in enumerate(own) if c.lower() == text_col.lower()]
    text_at = named[0] if named else len(own)
    taken = docs.select(*own, *([] if named else [F.col(text_col).alias("__text")]), spoken)
    out = schema.add("lang_pred", "string").add("score", "double")
    return taken.mapInArrow(tidy(rows), out)


def held_out(doc_id):
    """The fold that is never learned from: CRC-32 of the identifier as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
