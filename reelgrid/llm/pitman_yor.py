"""Hierarchical Pitman-Yor language model of word pairs, scored over whole texts.

Every word that precedes another has a restaurant whose customers are the words that follow it; all
of these restaurants share one parent, the restaurant of single words, whose customers are their
tables; its own parent is uniform over the vocabulary and one unknown word.

Seating is sampled by Gibbs. A restaurant with strength s, discount d and T tables has the factor
s (s+d) ... (s+d(T-1)), which ties its dishes together. With x drawn from Gamma(s/d + T), given the
tables, the dishes are independent: a dish with c customers has t tables with a weight of
S(c, t) (d x p)^t, where S are Stirling numbers generalised by d and p is the parent's probability of
the dish. So all dishes are drawn at once, from their conditionals, and no table count is stale: up to
EXACT customers from all t, beyond it by Metropolis steps, with S from series, over the whole
range of t, so any number of customers is seated anew in each sweep. A text's score averages the
predictive probability of each word over samples.

Everything is in blocks. Words are 64-bit hashes. A pair of words belongs to one of ROWS x COLUMNS
cells by the hashes of both, so a word that a third of all pairs have is spread over a whole row or
column; the pairs of a chunk of texts reach a cell as one row, counted by text. Each cell seats its
pairs and tells what it has counted and seated, in each sample, to the owners of its words: those of
words as dishes belong to its column, those of contexts to its row. Owners sum that up exactly.
The auxiliary variable of the shared parent comes from a chain over the numbers of its customers by
dish (one row for each distinct number); given it, owners seat their words, and their tables are summed
over all owners. Cells then score with these sums, so predictions add up to one in each sample.

What is approximated: cells sample contexts before the parent is known, with what the cell itself has
seen and seated of its words standing for it, and with as many tables of a context in each other column.

Defined results: a null text counts as empty, one end token; a row with a null id is not held out;
rows of one id are scored each, extra columns are ignored; without training text every word is
unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .textscan import mix, slices, word_hashes, words

U64 = np.uint64
#: Names of what begins and ends a text; words are hashes of bytes, these are fixed numbers.
START, END = U64(0x5354415254), U64(0x454E44)
#: Tokens that a chunk holds, and bytes of input for a cell.
CHUNK, CELL_BYTES = 2_500_000, 8 << 20


@dataclass(frozen=True)
class Prior:
    """Discounts and strengths of the pair restaurants and of their parent; samples and sweeps."""

    discount: float = 0.8
    strength: float = 5.0
    parent_discount: float = 0.8
    parent_strength: float = 10.0
    samples: int = 2
    sweeps: int = 2  # between samples
    burn_in: int = 3
    parent_sweeps: int = 8  # of the chain of the parent's auxiliary variable
    seed: int = 7


#: Customers up to which a dish's tables are drawn from all numbers; steps of the sampler beyond it.
EXACT, STEPS = 128, 24
#: Tables, over customers to the power of the discount, up to which S is expanded, and terms of it.
FEW, TERMS = 1.2, 34


@cache
def log_stirling(discount: float, most: int) -> np.ndarray:
    """log of generalised Stirling numbers S(c, t), t = 1..c <= most; -inf elsewhere."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = s[c - 1, t] + np.log(np.maximum(c - 1 - discount * t, 0))
        s[c, t] = np.logaddexp(s[c - 1, t - 1], stay)
    return s


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, from ten on; smaller arguments are raised by ten."""
    small = x < 10
    y = np.where(small, x + 10, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if small.any():
        raised = np.ones_like(y)
        for i in range(10):
            raised = raised * np.where(small, x + i, 1.0)
        out = out - np.log(raised)
    return out


class ManyCustomers:
    """log S(c, t) of dishes with many customers c, for 1 <= t <= c, up to a term for each dish.

    S(c, t) = c! / (t! d^t) [z^c] (1 - (1-z)^d)^t. For few tables the power is expanded, and its
    terms fall off quickly; for more the coefficient comes from a saddle point.
    """

    def __init__(self, d: float, c: np.ndarray):
        self.d, self.c = d, c.astype(float)
        self.few = FEW * self.c**d
        # Of each term of the expansion, over the first one's, what doesn't depend on t, and its sign.
        j = np.arange(2, TERMS)[:, None]
        self.size = _log_gamma(np.maximum(self.c - d * j, 1e-3)) - _log_gamma(self.c - d) + _log_gamma(1 + d * j) - math.lgamma(1 + d)
        self.sign = (-1.0) ** (j - 1) * np.sin(math.pi * d * j) / math.sin(math.pi * d) * (self.c > d * j)
        self.first = _log_gamma(self.c - d) - math.lgamma(1 - d)
        self.all = _log_gamma(self.c + 1)

    def __call__(self, t: np.ndarray) -> np.ndarray:
        out, t = np.zeros(len(t)), t.astype(float)
        few = np.flatnonzero(t <= self.few)
        if len(few):
            out[few] = self._expanded(few, t[few])
        some = np.flatnonzero((t > self.few) & (t < self.c))
        if len(some):
            out[some] = self._saddle(self.c[some], self.all[some], t[some])
        return out

    def _expanded(self, at: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The sum over j of (-1)^j binomial(t, j) [z^c] (1-z)^(dj), over its first term."""
        scale, total = np.zeros(len(t)), np.ones(len(t))
        for k in range(TERMS - 2):
            scale = scale + np.log(np.maximum(t - k - 1, 1e-300) / (k + 2))
            total += np.where(t >= k + 2, self.sign[k, at] * np.exp(scale + self.size[k, at]), 0.0)
        return self.first[at] - _log_gamma(t) - (t - 1) * math.log(self.d) + np.log(np.maximum(total, 1e-300))

    def _saddle(self, c: np.ndarray, all_: np.ndarray, t: np.ndarray) -> np.ndarray:
        d = self.d
        low, high = -(np.log(c / (t * d)) + 1) / (1 - d), np.full(len(c), -1e-12)  # log of y = 1 - z
        for _ in range(36):
            u = (low + high) / 2
            over = np.log(t * d / c) + np.log(-np.expm1(u)) + (d - 1) * u > np.log(-np.expm1(d * u))
            low, high = np.where(over, u, low), np.where(over, high, u)
        z, phi, ratio = -np.expm1(u), -np.expm1(d * u), c / t
        bend = np.exp(np.log(d * (1 - d)) + (d - 2) * u + 2 * np.log(z) - np.log(phi))
        spread = t * (ratio + bend - ratio**2)
        return all_ - _log_gamma(t + 1) - t * np.log(d) + t * np.log(phi) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-300))

    def top(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most probable t with weights S(c, t) exp(t weight), and the standard deviation around it."""
        d, c = self.d, self.c
        # At the top z y^(d-1) = c / exp(weight), with y = 1 - z.
        high = np.full(len(c), -1e-12)
        low = -(np.maximum(np.log(c) - weight, 0) + 2) / (1 - d)
        for _ in range(36):
            u = (low + high) / 2
            over = np.log(-np.expm1(u)) + (d - 1) * u > np.log(c) - weight
            low, high = np.where(over, u, low), np.where(over, high, u)
        t = np.clip(np.rint(np.exp(np.log(c) + np.log(-np.expm1(d * u)) - np.log(-np.expm1(u)) - np.log(d) - (d - 1) * u)), 1, c)
        h = np.clip(np.rint(t / 20), 1, None)
        a, b = np.clip(t - h, 1, c), np.clip(t + h, 1, c)
        bend = (2 * self(t) - self(a) - self(b) + (2 * t - a - b) * weight) / np.maximum(((b - a) / 2) ** 2, 1)
        return t, np.clip(1 / np.sqrt(np.maximum(bend, 1e-12)), 0.4, c)


def few_weights(discount: float, c: int, weight: np.ndarray) -> np.ndarray:
    """Cumulated weights of t = 1..c, up to a factor, for each log of (d x p)."""
    p = np.multiply.outer(weight, np.arange(1, c + 1.0)) + log_stirling(discount, EXACT)[c, 1 : c + 1]
    return np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)


def drawn_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each dish, drawn from its conditional; weight is log(d x p)."""
    tables = np.ones(len(customers), np.int64)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    for rows in np.split(few, np.flatnonzero(np.diff(customers[few])) + 1) if len(few) else []:
        c = int(customers[rows[0]])
        for at in range(0, len(rows), step := max(1, (1 << 20) // c)):
            part = rows[at : at + step]
            p = few_weights(discount, c, weight[part])
            tables[part] = 1 + (p < rng.random(len(part))[:, None] * p[:, -1:]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    for at in range(0, len(many), 1 << 16):
        part = many[at : at + (1 << 16)]
        tables[part] = _metropolis(customers[part], weight[part], discount, rng)
    return tables


def _metropolis(c: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers: a random walk as wide as the conditional, from its top."""
    f = ManyCustomers(d, c)
    t, width = f.top(weight)
    now = f(t) + t * weight
    for _ in range(STEPS):
        to = t + np.rint(rng.normal(size=len(c)) * 2.4 * width)
        inside = (to >= 1) & (to <= c)
        to = np.where(inside, to, t)
        then = f(to) + to * weight
        moves = inside & (np.log(rng.random(len(c))) < then - now)
        t, now = np.where(moves, to, t), np.where(moves, then, now)
    return t.astype(np.int64)


def parent_x(own: np.ndarray, kinds: np.ndarray, everything: int, prior: Prior, rng: np.random.Generator) -> float:
    """The parent's auxiliary variable, from a chain over how many words (kinds) have how many customers (own)."""
    d, total, x = prior.parent_discount, int(kinds.sum()), 1.0
    many = kinds[own > EXACT]
    far = ManyCustomers(d, own[own > EXACT]) if len(many) else None  # their sum is normal, for all purposes
    for sweep in range(prior.parent_sweeps + 1):
        x = rng.gamma(prior.parent_strength / d + total)
        weight = math.log(d * x / (everything + 1))
        if sweep == prior.parent_sweeps:
            break
        total = int(kinds[own == 1].sum())
        for c, n in zip(own.tolist(), kinds.tolist()):
            if 1 < c <= EXACT:
                p = few_weights(d, c, np.array([weight]))[0]
                total += int(rng.multinomial(n, np.diff(p, prepend=0) / p[-1]) @ np.arange(1, c + 1))
        if far is not None:
            top, width = far.top(np.full(len(many), weight))
            total += max(int(many.sum()), int(round(top @ many + rng.normal() * math.sqrt(width**2 @ many))))
    return x


def _pack(*columns: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


def _narrow(*columns: np.ndarray) -> list[bytes]:
    """Counts or places, in the fewest bytes that hold them all."""
    return [c.astype(f"<u{1 if (m := int(c.max(initial=0))) < 256 else 2 if m < 65536 else 4}").tobytes() for c in columns]


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}") if n else np.zeros(0, np.uint8)


def _written(names: pa.Array) -> bytes:
    with pa.ipc.new_stream(sink := pa.BufferOutputStream(), pa.schema([("names", names.type)])) as out:
        out.write(pa.record_batch([names], ["names"]))
    return sink.getvalue().to_pybytes()


def _joined(held: list[tuple]) -> list:
    *numbers, names = zip(*held)
    return [*map(np.concatenate, numbers), pa.concat_arrays(names)]


def _join(column: pa.ChunkedArray | pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs of a column, and how many each has."""
    blobs = column.to_pylist()
    values = np.frombuffer(b"".join(blobs), dtype)
    return values, np.array([len(b) // np.dtype(dtype).itemsize for b in blobs], np.int64)


PAIRS = "cell int, chunk long, context binary, runs binary, vocabulary binary, word binary, times binary, trained binary, texts binary, often binary, docs binary, sizes binary"


def pair_blobs(docs: DataFrame, rows: int, columns: int) -> DataFrame:
    """Counted pairs of words by cell and chunk: PAIRS.

    context, with the number of pairs of each (runs); vocabulary, and the place of each pair's word
    there (word); how many texts have the pair (times), how often it is in training texts (trained);
    for each of these texts its number in the chunk (texts), and how often it has the pair (often). One
    row of a chunk names its texts (docs) and tells their tokens (sizes).
    """

    def flush(number: int, u: np.ndarray, w: np.ndarray, doc: np.ndarray, train: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        about = [_written(names), *_narrow(np.bincount(doc, minlength=len(names)))]
        cell = ((mix(u, 1) % U64(rows)) * U64(columns) + mix(w, 2) % U64(columns)).astype(np.int32)
        order = np.lexsort((doc, w, u, cell))
        cell, u, w, doc = cell[order], u[order], w[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        trained = np.add.reduceat(train[doc].astype(np.int64), first)
        begins = np.zeros(len(u), bool)
        begins[first] = True
        held = np.flatnonzero(begins | np.concatenate([[True], doc[1:] != doc[:-1]]))
        often = np.diff(np.append(held, len(u)))
        at = np.append(np.searchsorted(held, first), len(held))  # of each pair among (pair, text)
        times, doc = np.diff(at), doc[held]
        cells, begin = np.unique(cell[first], return_index=True)
        for c, a, b in zip(cells.tolist(), begin.tolist(), [*begin[1:].tolist(), len(first)]):
            context, runs = np.unique(u[first[a:b]], return_counts=True)
            vocabulary, word = np.unique(w[first[a:b]], return_inverse=True)
            own = slice(at[a], at[b])
            values = [c, number, *_pack(context), *_narrow(runs), *_pack(vocabulary), *_narrow(word, times[a:b], trained[a:b], doc[own], often[own]), *about]
            about = [b"", b""]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), *[pa.binary()] * 10))], [x.split()[0] for x in PAIRS.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = n = number = 0
        # A chunk's number tells it from all others of the table.
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in slices(batch.column(2)):
                w = words(batch.column(2).slice(a, b - a))
                first = w.first
                ends = first[1:] + np.arange(1, w.n + 1)
                token = np.empty(len(w.start) + w.n, U64)
                token[np.arange(len(w.start)) + w.doc] = word_hashes(w)
                token[ends - 1] = END
                before = np.empty_like(token)
                before[1:] = token[:-1]
                before[np.concatenate([[0], ends[:-1]])] = START
                doc = (np.repeat(np.arange(w.n), np.diff(first) + 1) + n).astype(np.int32)
                held.append((before, token, doc, batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), batch.column(0).slice(a, b - a)))
                n, size = n + w.n, size + len(token)
                if size >= CHUNK:
                    yield from flush(part + number, *_joined(held))
                    held, size, n, number = [], 0, 0, number + 1
        if held:
            yield from flush(part + number, *_joined(held))

    return docs.select("_row", "_train", "text").mapInArrow(scan, PAIRS)


class Cell:
    """The pairs of one cell, from the blobs of all chunks."""

    def __init__(self, t: pa.Table):
        context, n = _join(t.column("context"), "<u8")
        vocabulary, m = _join(t.column("vocabulary"), "<u8")
        self.contexts, cof = np.unique(context, return_inverse=True)
        self.words, wof = np.unique(vocabulary, return_inverse=True)
        self.table, self.times, key, trained = t, [], [], []
        blobs = [t.column(k).to_pylist() for k in ("runs", "word", "times", "trained")]
        for i, x, j, y, runs, word, times, counted in zip(np.cumsum(n) - n, n, np.cumsum(m) - m, m, *blobs):
            runs = _wide(runs, x)
            total = int(runs.sum())
            key.append(np.repeat(cof[i : i + x], runs) * len(self.words) + wof[j : j + y][_wide(word, total)])
            self.times.append(_wide(times, total))
            trained.append(_wide(counted, total).astype(np.int64))
        pairs, self.of = np.unique(np.concatenate(key), return_inverse=True)
        self.u, self.w = pairs // len(self.words), pairs % len(self.words)
        self.count = np.bincount(self.of, np.concatenate(trained), len(pairs)).astype(np.int64)

    def seated(self, prior: Prior, number: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pairs seen in training, and the tables of each in each sample [samples, pairs].

        What this cell has seen and seated of its words stands for the parent, whose probability of all
        words in this column is about one in down. The same cell is seated alike each time.
        """
        on = np.flatnonzero(self.count)
        u, w, customers, rng = self.u[on], self.w[on], self.count[on], np.random.default_rng((prior.seed, number))
        tables, base, out = np.ones(len(on), np.int64), np.bincount(self.w[on], customers, len(self.words)), []
        for sweep in range(prior.burn_in + prior.sweeps * (prior.samples - 1)):
            x = rng.gamma(prior.strength / prior.discount + down * np.bincount(u, tables, len(self.contexts)))
            parent = base[w] / max(1.0, float(base.sum())) / down
            tables = drawn_tables(customers, np.log(prior.discount * x[u] * parent), prior.discount, rng)
            base = np.bincount(w, tables, len(self.words))
            if sweep >= prior.burn_in - 1 and (sweep - prior.burn_in + 1) % prior.sweeps == 0:
                out.append(tables)
        return on, np.array(out).reshape(prior.samples, len(on))

    def scores(self, *by_pair: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each blob its place, the numbers of its texts, and the sums over their tokens of what is given by pair."""
        at = 0
        for k, (times, texts, often) in enumerate(zip(self.times, *(self.table.column(c).to_pylist() for c in ("texts", "often")))):
            pair = np.repeat(self.of[at : at + len(times)], times)
            own, place = np.unique(_wide(texts, len(pair)), return_inverse=True)
            n = _wide(often, len(pair))
            yield k, own, [np.bincount(place, v[pair] * n, len(own)) for v in by_pair]
            at += len(times)


TOLD = "owner int, cell int, names binary, customers binary, tables binary"
BACK = "cell int, owner int, customers binary, tables binary, own binary, opened binary, tokens long, kinds long, seats binary"
SUMS = "chunk long, texts binary, known binary, base binary, score binary, docs binary, sizes binary, train_tokens long"
SCORES = "n_tokens long, n_known long, base_score double, score double, train_tokens long"


def model_scores(rows: DataFrame, prior: Prior, grid: tuple[int, int]) -> DataFrame:
    """_row, n_tokens, n_known, base_score, score, train_tokens of rows (_row, _train, text); what _row holds only goes along."""
    across, down = grid
    cells, samples = across * down, prior.samples
    pairs = pair_blobs(rows, across, down).repartition(cells, "cell")

    def owners_of(cell: Cell, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The owners of a cell's words, of which its column has as many as there are rows, and of its
        contexts, of which its row has as many as there are columns; these are numbered from cells on."""
        row, column = divmod(number, down)
        return column * across + (mix(cell.words, 3) % U64(across)).astype(np.int64), cells + row * down + (mix(cell.contexts, 3) % U64(down)).astype(np.int64)

    def told(t: pa.Table) -> pa.Table:
        """What a cell has counted and seated, for the owner of each of its words."""
        number, cell = t.column("cell")[0].as_py(), Cell(t)
        on, tables = cell.seated(prior, number, down)
        out = []
        for names, owner, of in zip((cell.words, cell.contexts), owners_of(cell, number), (cell.w[on], cell.u[on])):
            customers = np.bincount(of, cell.count[on], len(names)).astype("<u8")
            seated = np.stack([np.bincount(of, x, len(names)) for x in tables]).astype("<u4")
            order = np.argsort(owner, kind="stable")
            own, first = np.unique(owner[order], return_index=True)
            for o, part in zip(own.tolist(), np.split(order, first[1:])):
                out.append((o, number, *_pack(names[part], customers[part], seated[:, part].T)))
        return _table(out, TOLD)

    def asked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of one owner: its names, their customers and tables [names, samples], and the names of each cell's message."""
        name, n = _join(t.column("names"), "<u8")
        customers, tables = _join(t.column("customers"), "<u8")[0], _join(t.column("tables"), "<u4")[0].reshape(-1, samples)
        names, of = np.unique(name, return_inverse=True)
        total = np.bincount(of, customers, len(names)).astype(np.int64)
        return names, total, np.stack([np.bincount(of, x, len(names)).astype(np.int64) for x in tables.T], axis=1), np.split(of, np.cumsum(n)[:-1])

    def sized(t: pa.Table) -> pa.Table:
        """How many of an owner's words, and of their tokens, have how many tables in each sample."""
        out = []
        if t.column("owner")[0].as_py() < cells:
            _, seen, own, _ = asked(t)
            for k in range(samples):
                n, at = np.unique(own[:, k], return_inverse=True)
                out += zip([k] * len(n), n.tolist(), np.bincount(at, seen > 0).astype(int).tolist(), np.bincount(at, seen).astype(int).tolist())
        return _table(out, "sample int, own long, kinds long, tokens long")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row: tokens, kinds, the parent's customers and its auxiliary variable in each sample."""
        held = [np.concatenate(c) for c in zip(*([x.to_numpy() for x in b.columns] for b in batches))]
        seats, xs = np.zeros(samples, np.int64), np.ones(samples)
        of, own, n, tokens = held or [np.zeros(0, np.int64)] * 4
        everything = int(n[of == 0].sum())
        for k in range(samples):
            on = np.flatnonzero((of == k) & (own > 0))
            on = on[np.argsort(own[on])]
            seats[k] = int(own[on] @ n[on])
            xs[k] = parent_x(own[on], n[on], everything, prior, np.random.default_rng((prior.seed, 1 << 21, k)))
        yield pa.RecordBatch.from_arrays([pa.array([int(tokens[of == 0].sum())]), pa.array([everything]), *(pa.array([v.tobytes()], pa.binary()) for v in (seats, xs))], ["tokens", "kinds", "seats", "xs"])

    def answered(t: pa.Table, whole: pa.Table) -> pa.Table:
        """What the owner of some words tells each cell about them."""
        if not len(t):
            return _table([], BACK)
        owner, tokens, kinds, packed = t.column("owner")[0].as_py(), *(whole.column(k)[0].as_py() for k in ("tokens", "kinds", "seats"))
        t = t.sort_by("cell")
        names, total, tables, messages = asked(t)
        own, opened = np.zeros((len(names), samples)), np.zeros(samples, np.int64)
        if owner < cells:
            # The shared parent: its customers are the tables of all pair restaurants.
            d, rng = prior.parent_discount, np.random.default_rng((prior.seed, 1 << 20, owner))
            for k, (x, seats) in enumerate(zip(np.frombuffer(whole.column("xs")[0].as_py()), np.frombuffer(packed, np.int64))):
                on = np.flatnonzero(tables[:, k])
                seated = drawn_tables(tables[on, k], np.full(len(on), math.log(d * x / (kinds + 1))), d, rng)
                own[on, k] = (tables[on, k] - d * seated) / (prior.parent_strength + seats)
                opened[k] = seated.sum()
        out = []
        for cell, i in zip(t.column("cell").to_pylist(), messages):
            numbers = _pack(own[i]) if owner < cells else [b""]
            out.append((cell, owner, *_pack(total[i].astype("<u8")), b"" if owner < cells else tables[i].astype("<u4").tobytes(), *numbers, opened.tobytes(), tokens, kinds, packed))
            opened = np.zeros(samples, np.int64)  # told once
        return _table(out, BACK)

    def opened_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(samples, np.int64)
        for b in batches:
            for x in b.column("opened"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in total], [f"t{k}" for k in range(samples)])

    def scored(t: pa.Table, back: pa.Table) -> pa.Table:
        if not len(t):
            return _table([], SUMS)
        number, cell = t.column("cell")[0].as_py(), Cell(t)
        tokens, kinds, packed, all_tables = (back.column(k)[0].as_py() for k in ("tokens", "kinds", "seats", "all_tables"))
        # Owners answer in the order in which they were asked, so no names come back; those of contexts have higher numbers.
        back = back.sort_by("owner")
        w, c = (np.argsort(np.argsort(x, kind="stable")) for x in owners_of(cell, number))
        customers = _join(back.column("customers"), "<u8")[0].astype(float)
        dish, customers = customers[: len(w)][w], customers[len(w) :][c]
        tables = _join(back.column("tables"), "<u4")[0].reshape(-1, samples)[c].astype(float)
        parent = _join(back.column("own"), "<f8")[0].reshape(-1, samples)[w]
        on, seated = cell.seated(prior, number, down)
        p = np.zeros(len(cell.u))
        for k, seats in enumerate(np.frombuffer(packed, np.int64).tolist()):
            rest = (prior.parent_strength + prior.parent_discount * all_tables[k]) / (prior.parent_strength + seats) / (kinds + 1)
            of_word = parent[cell.w, k] + rest
            own = (prior.strength + prior.discount * tables[cell.u, k]) * of_word
            own[on] += cell.count[on] - prior.discount * seated[k]
            p += np.where(customers[cell.u] > 0, own / (prior.strength + customers[cell.u]), of_word)
        p = np.log10(p / samples)
        known = (dish > 0)[cell.w].astype(float)
        base = np.log10((dish + 1) / (tokens + kinds + 1))[cell.w]
        chunk, docs, sizes = (t.column(k).to_pylist() for k in ("chunk", "docs", "sizes"))
        out = []
        for k, texts, (score, n, b) in cell.scores(p, known, base):
            out.append((chunk[k], *_narrow(texts, np.rint(n)), *_pack(b, score), docs[k], sizes[k], tokens))
        return _table(out, SUMS)

    def summed(t: pa.Table) -> pa.Table:
        """The scores of the texts of one chunk, from all cells."""
        docs, sizes = (max(t.column(k).to_pylist(), key=len) for k in ("docs", "sizes"))
        names = pa.ipc.open_stream(docs).read_all().column("names")
        total = np.zeros((3, len(names)))
        for texts, *sums in zip(*(t.column(k).to_pylist() for k in ("texts", "known", "base", "score"))):
            n = len(sums[2]) // 8
            own = _wide(texts, n)
            for to, values in zip(total, (_wide(sums[0], n), np.frombuffer(sums[1], "<f8"), np.frombuffer(sums[2], "<f8"))):
                to[own] += values
        known, base, score = total
        return pa.table({"_row": names, "n_tokens": _wide(sizes, len(names)).astype(np.int64), "n_known": np.rint(known).astype(np.int64), "base_score": base, "score": score, "train_tokens": np.full(len(names), t.column("train_tokens")[0].as_py())})

    ask = pairs.groupBy("cell").applyInArrow(told, TOLD).repartition(cells, "owner")
    counted = ask.groupBy("owner").applyInArrow(sized, "sample int, own long, kinds long, tokens long")
    counted = counted.groupBy("sample", "own").agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens"))
    # As many rows as there are distinct numbers of tables: about the root of the table count.
    whole = counted.coalesce(1).mapInArrow(chain, "tokens long, kinds long, seats binary, xs binary")
    owners = F.explode(F.sequence(F.lit(0), F.lit(2 * cells - 1))).alias("owner")
    reply = ask.groupBy("owner").cogroup(whole.select("*", owners).groupBy("owner")).applyInArrow(answered, BACK).repartition(cells, "cell")
    totals = reply.mapInArrow(opened_tables, ", ".join(f"t{k} long" for k in range(samples))).agg(F.array(*[F.sum(f"t{k}") for k in range(samples)]))
    back = reply.withColumn("all_tables", totals.scalar())
    sums = pairs.groupBy("cell").cogroup(back.groupBy("cell")).applyInArrow(scored, SUMS)
    return sums.groupBy("chunk").applyInArrow(summed, f"_row {rows.schema['_row'].dataType.simpleString()}, {SCORES}")


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for c, (name, kind) in zip(columns, fields)})


def text_scores(docs: DataFrame, prior: Prior = Prior(), grid: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of a token) of every row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    if grid is None:
        side = max(4, round((text_bytes(docs) / CELL_BYTES) ** 0.5))
        grid = (side, side)
    scores = model_scores(docs.select(F.col("doc_id").alias("_row"), (~held).alias("_train"), "text"), prior, grid).withColumnRenamed("_row", "doc_id")
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity_of(F.col("score"), F.col("n_tokens")).alias("perplexity"))


def perplexity_of(score: Column, tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / tokens)


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity: of training and of held-out texts, by token, from text_scores()."""
    total = scores.groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("n_tokens").alias("n_tokens"))
    return total.select("held_out", "n_tokens", perplexity_of(F.col("score"), F.col("n_tokens")).alias("perplexity"))
