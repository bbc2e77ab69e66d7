"""Language-model scoring with a hierarchical Pitman-Yor process.

One restaurant for each word that another one follows (and for the start of a text) shares the unigram restaurant as its
parent, whose base is uniform over the V known words and one unknown. Customers of a word in a context sit at t tables,
each of which sends a customer to the parent. Gibbs sampling takes all customers of a pair (context, word) out and draws
their number of tables anew, by the law that the Chinese-restaurant rule gives it if all of them eat this word: the
weights of all seatings are generalised Stirling numbers. It is given the tables of the restaurant and the word's chance
in the parent. Both are sums by context and by word, made before each sweep and held over within it. A pair that occurs
once has one table whatever is drawn, so it counts in the sums but isn't reseated. Discounts are told from how
many pairs, or words, were met once and twice. Predictive probabilities are averaged over the samples of the last sweeps, each with the tables of its own seating, so the chances in a context sum to 1.

Pairs lie in a square of cells, a range of hashes of contexts by one of words, so that no frequent context or word lies in
one cell: its pairs are dealt over a row or a column of cells. A cell is one row of packed arrays, and so is the list of all
words or contexts of a range. Pairs name their word and context by place in these lists, so sums and chances go between
cells and lists as arrays in the list's order. The number of cells goes with the length of all texts.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchspark.llm import store
from patchspark.llm.langid import remainder
from patchspark.llm.packed import from_gaps, gaps, pack, unpack
from patchspark.llm.shingles import blocks, mixed, words
from patchspark.llm.store import discard

SAMPLES, START = 3, 0
#: Strengths of the context restaurants and of the parent.
CONTEXT, PARENT = 2.0, 10.0
#: Customers and tables up to which the weights of seatings are tabulated, and numbers of a block of them.
MOST_N, MOST_T, AT_ONCE = 2048, 512, 1_000_000
END = np.uint64(0x243F6A8885A308D3)
#: Bytes of training text for each cell of pairs.
CELL = 14_000_000
#: Tokens and texts of a run that is sorted at once.
FLUSH, FLUSH_TEXTS = 1_500_000, 1 << 18
#: Over so many pieces ids are dealt on their way around the cells.
PIECES = 4096

written = partial(store.written, drop_shuffles=True)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash, context) of each token in order; every text ends with an END. The context is the word before, or START."""
    of, hashed = words(texts)
    n = np.bincount(of, minlength=len(texts))
    at = np.cumsum(n + 1) - 1  # of the ends
    out = np.empty(len(hashed) + len(texts), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[at] = True
    out[is_end], out[~is_end] = END, hashed
    context = np.full(len(out), START, np.uint64)
    context[1:] = out[:-1]
    context[at[:-1] + 1] = START
    return np.repeat(np.arange(len(texts)), n + 1), out, context


def bucket(keys: np.ndarray, side: int) -> np.ndarray:
    """Which of side equal ranges of hashes each key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(side) >> np.uint64(32)).astype(np.int64)


def _runs(batches):
    """(text number, word, whether its context is START, ids) of runs of texts, of FLUSH tokens at most unless one block has more."""
    held, n, texts = [], 0, 0

    def joined():
        run = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return run

    for batch in batches:
        ids = batch.column("id").to_numpy()
        for first, block in blocks(batch.column("text").to_pylist()):
            of, word, context = tokens(block)
            if held and (n + len(word) > FLUSH or texts + len(block) > FLUSH_TEXTS):
                yield joined()
                n, texts = 0, 0
            held.append(((of + texts).astype(np.int32), word, context == START, ids[first : first + len(block)]))
            n, texts = n + len(word), texts + len(block)
    if held:
        yield joined()


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where other keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)]))


def _counted(c: np.ndarray, w: np.ndarray, of: np.ndarray) -> tuple:
    """(context, word, text, count) of equal tokens, in this order, with contexts and words as numbers."""
    bits = [int(x.max()).bit_length() for x in (c, w, of)]
    if sum(bits) < 64:
        key = c.astype(np.uint64)
        for x, k in ((w, bits[1]), (of, bits[2])):
            key <<= np.uint64(k)
            key |= x.astype(np.uint64)
        key.sort()
        at, total = _starts(key), len(key)
        key = key[at]
        low = lambda x, k: (x & np.uint64((1 << k) - 1)).astype(np.int32)
        c, w, of = low(key >> np.uint64(bits[1] + bits[2]), bits[0]), low(key >> np.uint64(bits[2]), bits[1]), low(key, bits[2])
    else:
        order = np.lexsort((of, w, c))
        c, w, of, total = c[order], w[order], of[order], len(c)
        at = _starts(c, w, of)
        c, w, of = c[at], w[at], of[at]
    return c, w, of, np.diff(np.append(at, total))


def _local(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers below size, sorted, and the place of each of x among them."""
    there = np.zeros(size, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


def _by_cell(of: np.ndarray, word: np.ndarray, first: np.ndarray, side: int, by_text: bool):
    """(cell, arrays) of a run's part in each cell: its words, contexts and their pairs, sorted by context and word.

    n counts the pairs; with by_text it counts them in each of their texts (of), of which every pair has a number (texts).
    """
    words, w = np.unique(word, return_inverse=True)
    w = w.astype(np.int32)
    contexts = np.concatenate([np.full(1, START, np.uint64), words])  # what isn't START is the word before
    c = np.where(first, np.int32(0), np.concatenate([w[:1], w[:-1]]) + np.int32(1))
    c, w, of, n = _counted(c, w, of if by_text else np.zeros(len(w), np.int32))
    small = np.uint16 if side <= 256 else np.int64
    cell = (bucket(contexts, side) * side).astype(small)[c] + bucket(words, side).astype(small)[w]
    order = np.argsort(cell, kind="stable")
    ends = np.cumsum(np.bincount(cell, minlength=side * side))
    for i in np.unique(cell):
        part = order[ends[i - 1] if i else 0 : ends[i]]
        own, pw = _local(w[part], len(words))
        at = _starts(c[part], pw)
        pc = c[part][at]
        new = _starts(pc)
        arrays = {"words": gaps(words[own]), "contexts": gaps(contexts[pc[new]]), "runs": np.diff(np.append(new, len(pc))), "w": pw[at]}
        arrays |= {"texts": np.diff(np.append(at, len(part))), "of": of[part]} if by_text else {}
        yield int(i), arrays | {"n": n[part]}


def _table(rows: list[tuple], schema: str):
    """The rows as a table of a schema in Spark's words."""
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=fields)


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) for the step-th draw of each seed."""
    return ((mixed(seed + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


@lru_cache(4)
def _log_stirling(d: float) -> np.ndarray:
    """[n, t - 1]: log of the generalised Stirling number S(n, t), the weight of all ways to seat n at t tables, up to MOST_N and MOST_T."""
    out = np.full((MOST_N + 1, MOST_T), -np.inf)
    out[1, 0] = 0
    t = np.arange(1, MOST_T + 1)
    for n in range(1, MOST_N):
        k = min(n, MOST_T)
        out[n + 1, :k] = np.log(n - d * t[:k]) + out[n, :k]
        out[n + 1, 1 : k + 1] = np.logaddexp(out[n + 1, 1 : k + 1], out[n, :k][: MOST_T - 1])
    return out


@lru_cache(8192)
def _table_weights(n: int, d: float, width: int) -> np.ndarray:
    """log S(n, t) for t from 1 to width, less what all t have in common.

    Beyond MOST_N the recurrence is followed in log n, where it has a closed form: state j decays by (j - 1) d and feeds j + 1.
    """
    if n <= MOST_N:
        return _log_stirling(d)[n, : min(n, width)]
    far, start = np.log(n / MOST_N), _log_stirling(d)[MOST_N, :width]
    j = np.arange(width)
    steps = j[:, None] - j[None, :]
    log_factorial = np.concatenate([[0], np.cumsum(np.log(np.arange(1, width)))])
    ways = np.where(steps >= 0, steps * np.log(-np.expm1(-d * far) / d) - log_factorial[np.maximum(steps, 0)], -np.inf) + (start - j * d * far)[None, :]
    top = ways.max(1)
    return top + np.log(np.exp(ways - top[:, None]).sum(1)) - start[0]


def _seat(n: np.ndarray, a: np.ndarray, d: float, seed: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables of n customers of one dish, drawn from their law given that all n eat it.

    t tables have the weight S(n, t) * product of a + more * s for s below t - 1: a new table's odds, whatever the order. At most
    MOST_T tables are told apart.
    """
    more, tables, u = np.broadcast_to(more, len(n)), np.ones(len(n)), _uniform(seed, 1)
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 1]
    for group in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(order) else []:
        # about a / d tables are likely, so a few times that are told apart, in steps of a power of two
        width = 64
        while width < min(MOST_T, 16 + 4 * (a[group].max() + width * more[group].max()) / d):
            width *= 2
        weights = _table_weights(int(n[group[0]]), d, width)
        before = np.arange(len(weights) - 1)
        for at in np.array_split(group, len(group) * len(weights) // AT_ONCE + 1):
            p = np.tile(weights, (len(at), 1))
            p[:, 1:] += np.cumsum(np.log(a[at][:, None] + more[at][:, None] * before), axis=1)
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), axis=1)
            tables[at] = 1 + (p < u[at][:, None] * p[:, -1:]).sum(1)
    return tables


def discount(once: float, twice: float) -> float:
    """The discount that counts of things met once and twice speak for, within 0.05 and 0.95."""
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.05, 0.95))


def _seed(of: np.ndarray, sweep: int) -> np.ndarray:
    return mixed(of.view(np.uint64) + np.uint64(sweep * 0xD1342543DE82EF95 & (1 << 64) - 1))


class Back:
    """back[:, context]: what a context leaves to its parent, one number a sample; 1 where nothing was seen."""

    def __init__(self, contexts: DataFrame):
        self.contexts = contexts
        self.last = None

    def __getitem__(self, at) -> np.ndarray:
        if self.last is None or self.last[0] != at[1]:
            found = self.contexts.where(F.col("context") == int(at[1])).first()
            self.last = at[1], np.array(found["back"]) if found else np.ones(SAMPLES)
        return self.last[1][at[0]]


CELLS, LISTS, DEALT = "cell int, data binary", "at int, data binary", "cell int, part string, data binary"
RAW, KEYS = "cell int, data binary, once double, twice double", "at int, data binary, keys double, n double, once double, one double, two double"
PARENTS = "at int, data binary, c0 array<double>, t0 array<double>"


def _batches(rows, schema: str):
    """Each row as a batch of its own: a row is large."""
    for row in rows:
        yield from _table([row], schema).to_batches()


def _each(batches, key: str = "cell"):
    for batch in batches:
        for k, data in zip(batch.column(key).to_pylist(), batch.column("data"), strict=True):
            yield k, unpack(data.as_py())


def _contexts(p: dict) -> np.ndarray:
    """The place of each pair's context among those of its cell."""
    return np.repeat(np.arange(len(p["runs"])), p["runs"].astype(np.int64))


def _runs_counted(batches, side: int):
    yield from _batches(((cell, pack(**arrays)) for run in _runs(batches) for cell, arrays in _by_cell(*run[:3], side, False)), CELLS)


def _cell_counted(key, table):
    """The pairs of a cell from those of its runs."""
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    both = {k: [from_gaps(p[k]) for p in parts] for k in ("words", "contexts")}
    words, contexts = (np.unique(np.concatenate(both[k])) for k in ("words", "contexts"))
    pair = np.concatenate([np.searchsorted(contexts, c)[_contexts(p)] * len(words) + np.searchsorted(words, w)[p["w"]] for p, w, c in zip(parts, both["words"], both["contexts"], strict=True)])
    order = np.argsort(pair)
    at = _starts(pair[order])
    n = np.add.reduceat(np.concatenate([p["n"] for p in parts])[order], at)
    c, w = np.divmod(pair[order[at]], len(words))
    data = pack(words=gaps(words), contexts=gaps(contexts), runs=np.bincount(c, minlength=len(contexts)), w=w, n=n)
    return _table([(key[0].as_py(), data, (n == 1).sum(), (n == 2).sum())], RAW)


def _keys_of_cells(batches, side: int):
    """Words and contexts of each cell with their counts, the pairs that occur once and all pairs, for the list of their range."""

    def rows():
        for cell, p in _each(batches):
            for at, keys, of in ((cell % side, "words", p["w"].astype(np.int64)), (side + cell // side, "contexts", _contexts(p))):
                k = len(p[keys])
                yield at, pack(keys=p[keys], n=np.bincount(of, p["n"], k), once=np.bincount(of, p["n"] == 1, k), pairs=np.bincount(of, minlength=k))

    yield from _batches(rows(), LISTS)


def _listed(key, table):
    """The list of all keys of a range, in order."""
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    own = [from_gaps(p["keys"]) for p in parts]
    keys = np.unique(np.concatenate(own))
    sums = {k: np.zeros(len(keys), np.int64) for k in ("n", "once", "pairs")}
    for p, x in zip(parts, own, strict=True):
        at = np.searchsorted(keys, x)
        for k in sums:
            sums[k][at] += p[k].astype(np.int64)
    stats = len(keys), sums["n"].sum(), sums["once"].sum(), (sums["pairs"] == 1).sum(), (sums["pairs"] == 2).sum()
    return _table([(key[0].as_py(), pack(keys=gaps(keys), n=sums["n"], once=sums["once"]), *stats)], KEYS)


def _dealt(lists: DataFrame, side: int) -> DataFrame:
    """Each list for all cells whose pairs have keys in it: (cell, part, data)."""
    other = lists.select("at", "data", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("other"))
    is_word = F.col("at") < side
    cell = F.when(is_word, F.col("other") * side + F.col("at")).otherwise((F.col("at") - side) * side + F.col("other"))
    return other.select(cell.alias("cell"), F.when(is_word, "words").otherwise("contexts").alias("part"), "data")


def _parts(table) -> dict:
    return {part: unpack(data) for part, data in zip(table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True)}


def _placed(key, cells, lists):
    """A cell's pairs by place in the lists; and those that occur more often with their hashes, one table each."""
    schema = "cell int, data binary, many binary"
    if not cells.num_rows:
        return _table([], schema)
    p, of = unpack(cells.column("data")[0].as_py()), _parts(lists)
    every = {k: from_gaps(of[k]["keys"]) for k in ("words", "contexts")}
    own = {k: from_gaps(p[k]) for k in every}
    place = {k: np.searchsorted(every[k], own[k]) for k in every}
    w, c, n = p["w"].astype(np.int64), _contexts(p), p["n"]
    many = n > 1
    ws, mw = _local(w[many], len(own["words"]))
    cs, mc = _local(c[many], len(own["contexts"]))
    left = {"words": gaps(own["words"][ws]), "at_word": gaps(place["words"][ws]), "contexts": gaps(own["contexts"][cs]), "at_context": gaps(place["contexts"][cs]),
            "sizes": np.array([len(every["words"]), len(every["contexts"])]), "runs": np.bincount(mc, minlength=len(cs)), "w": mw, "n": n[many], "t": np.ones(len(mw))}
    return _table([(key[0].as_py(), pack(c=gaps(place["contexts"][c]), w=place["words"][w], n=n), pack(**left))], schema)


def _tables(batches, side: int, drawn: list[str]):
    """Tables of a cell's reseated pairs by word and by context, in the order of the lists."""

    def rows():
        for cell, p in _each(batches):
            for at, size, place in ((cell % side, p["sizes"][0], from_gaps(p["at_word"])[p["w"]]), (side + cell // side, p["sizes"][1], from_gaps(p["at_context"])[_contexts(p)])):
                yield at, pack(**{f"s{i}": np.bincount(place.astype(np.int64), p[k], int(size)) for i, k in enumerate(drawn)})

    yield from _batches(rows(), LISTS)


def _parents(key, lists, sums, side: int, draws: list[tuple[int, float]], d: float, whole: bool):
    """Tables of all pairs by key of a list, a number a draw (sweep, base); words are seated in the parent for each."""
    at, own = key[0].as_py(), unpack(lists.column("data")[0].as_py())
    given = [unpack(x) for x in sums.column("data").to_pylist()]
    out = {f"s{i}": own["once"] + sum((p[f"s{i}"] for p in given), np.zeros(len(own["once"]), np.uint64)) for i in range(len(draws))}
    if at < side:
        words = from_gaps(own["keys"])
        for i, (sweep, base) in enumerate(draws):
            out[f"t{i}"] = _seat(out[f"s{i}"].astype(float), np.full(len(words), base), d, _seed(words, sweep))
    totals = [[float(out[f"{k}{i}"].sum()) if f"{k}{i}" in out else 0.0 for i in range(len(draws))] for k in "st"]
    return _table([(at, pack(**out, **({"keys": own["keys"], "n": own["n"]} if whole else {})), *totals)], PARENTS)


def _in_parent(p: dict, i: int, d: float, base: float, total: float) -> np.ndarray:
    """The chance of each word of a list in the parent."""
    return (p[f"s{i}"] - d * p[f"t{i}"].astype(float) + base) / (PARENT + total)


def _reseated(key, cells, lists, sweep: int, d: float, parent: tuple[float, float, float], sample: int):
    """A cell's pairs with the tables of this sweep, from the other tables of their restaurant and the word's chance in the parent."""
    if not cells.num_rows:
        return _table([], CELLS)
    p, of = unpack(cells.column("data")[0].as_py()), _parts(lists)
    w, c, n = p["w"].astype(np.int64), _contexts(p), p["n"].astype(np.int64)
    p0 = _in_parent(of["words"], 0, *parent)[from_gaps(p["at_word"])][w]
    tables = of["contexts"]["s0"].astype(float)[from_gaps(p["at_context"])][c]
    others = np.maximum(tables - p["t"].astype(float), 0)  # at the first table of the dish itself d more count
    seed = mixed(_seed(from_gaps(p["words"])[w], sweep) + from_gaps(p["contexts"])[c])
    p["t"] = _seat(n, (CONTEXT + d * (others + 1)) * p0, d, seed, d * p0)
    return _table([(key[0].as_py(), pack(**p, **({f"d{sample}": p["t"]} if sample >= 0 else {})))], CELLS)


def _seats(batches):
    """Tables of all samples of a cell's reseated pairs together."""
    yield from _batches(((cell, pack(seats=sum(p[f"d{i}"] for i in range(SAMPLES)))) for cell, p in _each(batches)), CELLS)


def _over(p: dict, seats: dict | None, d: float) -> np.ndarray:
    """What is left of a cell's pairs above their discounts."""
    mean = np.ones(len(p["n"]))
    if seats:
        mean[p["n"] > 1] = seats["seats"] / SAMPLES
    return np.maximum(p["n"] - d * mean, 0)


def _chances(p: dict, m: dict) -> np.ndarray:
    """[word of a list, sample]: its chance in the parent."""
    return np.stack([_in_parent(p, i, m["discounts"][1], m["bases"][i], m["totals"][i]) for i in range(SAMPLES)], 1)


def _left(p: dict, m: dict) -> np.ndarray:
    """[context of a list, sample]: what it leaves to the parent."""
    return np.stack([(CONTEXT + m["discounts"][0] * p[f"s{i}"]) / (CONTEXT + p["n"]) for i in range(SAMPLES)], 1)


def _as_rows(batches, names: list[str], numbers, m: dict):
    """(key, count, numbers) of each key of the lists."""
    for _, p in _each(batches, "at"):
        lists = pa.FixedSizeListArray.from_arrays(pa.array(numbers(p, m).ravel()), SAMPLES).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(from_gaps(p["keys"]).view(np.int64)), pa.array(p["n"].astype(np.int64)), lists], names)


def _pairs_as_rows(key, model, d: float):
    of, schema = _parts(model), "word long, context long, n long, over double"
    if "pairs" not in of:
        return _table([], schema)
    p = of["pairs"]
    keys = [from_gaps(of[k]["keys"])[at].view(np.int64) for k, at in (("words", p["w"]), ("contexts", from_gaps(p["c"])))]
    return pa.table([*keys, p["n"].astype(np.int64), _over(p, of.get("seats"), d)], names=["word", "context", "n", "over"])


def fit(train: DataFrame, burn_in: int = 3) -> tuple[DataFrame, dict]:
    """(word table, model) from the texts of train.

    The model's tables are pairs (word, context, n, over), contexts (context, customers, back) and words (word, n, p0),
    with back and p0 one number a sample. The chance of a word in a context is over / (CONTEXT + customers), 0 if the pair
    was not seen, + the mean of back[sample] * p0[sample]. Counts cover all texts. These tables, and the word table that
    lists contexts and their part of the chance (extra) by word, are for looking at and made when they are read; scoring
    uses the cells and lists that they come from. Only single numbers come to the driver.
    """
    size = train.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    side = max(2, int(np.ceil(np.sqrt(size / CELL))))
    texts = train.select(F.lit(0).cast("long").alias("id"), "text")
    raw = written(texts.mapInArrow(lambda b: _runs_counted(b, side), CELLS).groupBy("cell").applyInArrow(_cell_counted, RAW), "counts")
    lists = written(raw.select("cell", "data").mapInArrow(lambda b: _keys_of_cells(b, side), LISTS).groupBy("at").applyInArrow(_listed, KEYS), "lists")
    single = lambda df, *names: [float(x or 0) for x in df.agg(*(F.sum(c) for c in names)).first()]
    n_keys, n, once, one, two = single(lists.where(F.col("at") < side), "keys", "n", "once", "one", "two")
    d, d0 = discount(*single(raw, "once", "twice")), discount(one, two)
    m = {"V": int(n_keys), "N": int(n), "discounts": (d, d0), "side": side}
    lists = lists.select("at", "data")

    def meet(cells: DataFrame, dealt: DataFrame, f, schema: str) -> DataFrame:
        return cells.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(f, schema)

    def parent(seated: DataFrame, drawn: list[str], draws: list, whole: bool = False) -> tuple[DataFrame, list, list]:
        """The lists with tables as drawn, the parent's base and its tables or customers in all."""
        sums = seated.mapInArrow(lambda b: _tables(b, side, drawn), LISTS)
        out = written(lists.groupBy("at").cogroup(sums.groupBy("at")).applyInArrow(lambda k, x, y: _parents(k, x, y, side, draws, d0, whole), PARENTS), "parent")
        k = range(len(draws))
        total = single(out.where(F.col("at") < side), *(F.col(c)[i] for c in ("c0", "t0") for i in k))
        return out.select("at", "data"), [(PARENT + d0 * total[len(draws) + i]) / (m["V"] + 1) for i in k], total[: len(draws)]

    placed = written(meet(raw.select("cell", "data"), _dealt(lists, side), _placed, "cell int, data binary, many binary"), "placed")
    discard(raw)
    pairs, seated = written(placed.select("cell", "data"), "pairs"), written(placed.select("cell", F.col("many").alias("data")), "seated")
    discard(placed)
    now, bases, totals = parent(seated, ["t"], [(0, (PARENT + d0 * m["V"]) / (m["V"] + 1))])
    draws = []
    for sweep in range(1, burn_in + SAMPLES + 1):
        sample = sweep - burn_in - 1
        new = written(meet(seated, _dealt(now, side), partial(_reseated, sweep=sweep, d=d, parent=(d0, bases[0], totals[0]), sample=sample), CELLS), "seated")
        discard(seated)
        discard(now)
        seated = new
        if sample >= 0:
            draws.append((sweep, bases[0]))
        if sweep < burn_in + SAMPLES:
            now, bases, totals = parent(seated, ["t"], [(sweep, bases[0])])
    now, m["bases"], m["totals"] = parent(seated, [f"d{i}" for i in range(SAMPLES)], draws, True)
    words, contexts = written(now.where(F.col("at") < side), "word-model"), written(now.where(F.col("at") >= side), "context-model")
    seats = written(seated.mapInArrow(_seats, CELLS), "seated")
    for done in (now, seated, lists):
        discard(done)
    part = lambda df, name: df.select("cell", F.lit(name).alias("part"), "data")
    m["cells"] = part(pairs, "pairs").unionByName(part(seats, "seats")).unionByName(_dealt(words, side)).unionByName(_dealt(contexts, side))
    m["unknowns"] = [m["bases"][i] / (PARENT + m["totals"][i]) for i in range(SAMPLES)]
    fixed = {k: m[k] for k in ("discounts", "bases", "totals")}
    m |= {"unknown": float(np.mean(m["unknowns"])), "pairs": m["cells"].groupBy("cell").applyInArrow(lambda k, x: _pairs_as_rows(k, x, d), "word long, context long, n long, over double"),
          "words": words.mapInArrow(lambda b: _as_rows(b, ["word", "n", "p0"], _chances, fixed), "word long, n long, p0 array<double>"),
          "contexts": contexts.mapInArrow(lambda b: _as_rows(b, ["context", "customers", "back"], _left, fixed), "context long, customers long, back array<double>")}
    m["back"] = Back(m["contexts"])
    extra = F.struct("context", (F.col("over") / (CONTEXT + F.col("customers"))).alias("extra"))
    by_word = m["pairs"].join(m["contexts"], "context").groupBy("word").agg(F.collect_list(extra).alias("c"))
    return m["words"].join(by_word, "word").select("word", "n", "p0", F.col("c.context").alias("contexts"), F.col("c.extra").alias("extra")), m


ASKED, ANSWERS = "cell int, block long, data binary", "block long, data binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _asked(batches, side: int):
    """The pairs of runs of texts for each cell, with their texts; and the ids of each run, by themselves under a cell below 0."""

    def rows():
        for i, (of, word, first, ids) in enumerate(_runs(batches)):
            # told by what is in it too, so that a task that is run again on other rows isn't mixed up with what it sent before
            digest = mixed(mixed(word + mixed(of.astype(np.uint64))).sum(keepdims=True) + mixed(ids.astype(np.uint64)).sum() + np.uint64(TaskContext.get().partitionId() << 32 | i))
            block, cells = int(digest.view(np.int64)[0]), 0
            unit = 34 if len(word) < 1 << 26 else 24
            for cell, arrays in _by_cell(of, word, first, side, True):
                yield cell, block, pack(**arrays, unit=np.array([unit]))
                cells += 1
            yield -1 - block % PIECES, block, pack(id=ids.view(np.uint64), tokens=np.bincount(of, minlength=len(ids)), cells=np.array([cells]), unit=np.array([unit]))

    yield from _batches(rows(), ASKED)


def _found(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in sorted keys, their number if it isn't there."""
    at = np.searchsorted(keys, x)
    there = at < len(keys)
    there[there] = keys[at[there]] == x[there]
    return np.where(there, at, len(keys))


def _answered(key, asked, model, m: dict):
    """The sums of each text over its pairs in a cell, in parts of one; ids go on as they are."""
    asks = zip(asked.column("block").to_pylist(), asked.column("data"), strict=True)
    if key[0].as_py() < 0:
        return _table([(block, data.as_py()) for block, data in asks], ANSWERS)
    # one part at a time is unpacked, for memory; what is not in the lists comes last
    packed, out = dict(zip(model.column("part").to_pylist(), model.column("data"), strict=True)), []
    none = pack(**dict.fromkeys(("keys", "n", *(f"{k}{i}" for k in "st" for i in range(SAMPLES))), np.zeros(0)))
    part = lambda name: unpack(packed[name].as_py() if name in packed else none)
    p = part("words")
    every_w, p0 = from_gaps(p["keys"]), np.vstack([_chances(p, m), m["unknowns"]])
    base = np.log10((np.append(p["n"], np.uint64(0)).astype(float) + 0.5) / (m["N"] + 0.5 * (m["V"] + 1)))
    p = part("contexts")
    every_c, back, customers = from_gaps(p["keys"]), np.vstack([_left(p, m), np.ones(SAMPLES)]), np.append(p["n"], np.uint64(0)).astype(float)
    pairs, over, wide = np.zeros(0, np.int64), np.zeros(1), len(every_w) + 1
    if "pairs" in packed:
        p = part("pairs")
        over = np.append(_over(p, part("seats") if "seats" in packed else None, m["discounts"][0]), 0.0)
        pairs = from_gaps(p["c"]).astype(np.int64) * wide + p["w"].astype(np.int64)
    del p
    for block, data in asks:
        p = unpack(data.as_py())
        w, c = _found(every_w, from_gaps(p["words"])), _found(every_c, from_gaps(p["contexts"]))
        w, c, text, n, unit = w[p["w"]], c[_contexts(p)], p["of"].astype(np.int64), p["n"].astype(float), 2.0 ** int(p["unit"][0])
        chance = over[_found(pairs, c * wide + w)] / (CONTEXT + customers[c]) + sum(back[c, i] * p0[w, i] for i in range(SAMPLES)) / SAMPLES
        score = np.log10(chance) if m["V"] else np.zeros(len(w))
        pair = np.repeat(np.arange(len(w)), p["texts"].astype(np.int64))
        own, at = _local(text, int(text.max()) + 1)
        parts = {k: np.rint(np.maximum(0.0, -np.bincount(at, n * x[pair], len(own))) * unit) for k, x in (("base", base[w]), ("score", score))}
        out.append((block, pack(of=gaps(own), known=np.bincount(at, n * (w < len(every_w))[pair], len(own)), **parts)))
    return _table(out, ANSWERS)


def _assembled(key, table):
    """The texts of a run with their sums over all cells."""
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    heads, answers = [p for p in parts if "id" in p], [p for p in parts if "id" not in p]
    if len(heads) != 1 or len(answers) != heads[0]["cells"][0]:
        raise RuntimeError("a run of texts came apart: its rows changed when a task was run again")
    sums = {k: np.zeros(len(heads[0]["id"]), np.uint64) for k in ("known", "base", "score")}
    for p in answers:
        at = from_gaps(p["of"])
        for k in sums:
            sums[k][at] += p[k]
    base, score = (0.0 - sums[k] / 2.0 ** int(heads[0]["unit"][0]) for k in ("base", "score"))
    whole = (x.astype(np.int64) for x in (heads[0]["id"], heads[0]["tokens"], sums["known"]))
    return pa.table([*whole, base, score], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: DataFrame, m: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (both log10) of each row of docs.

    Pairs of runs of texts, with the texts they are in, meet the cells; the sums of each text meet by run. Defined cases:
    a null or empty text is one END; an unknown word has what the parent keeps for it; a context that was not seen leaves
    all to the parent; without training texts only the unknown is left, with chance 1; every row is scored by itself, also
    of equal rows or rows that share a doc_id; very long texts are scored whole; no rows give no rows.
    """
    last, side = F.lit(2**63 - 1), m["side"]
    fixed = {k: m[k] for k in ("V", "N", "discounts", "bases", "totals", "unknowns")}
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.col(text_col).alias("text"))
    asked = rows.mapInArrow(lambda b: _asked(b, side), ASKED)
    answers = asked.groupBy("cell").cogroup(m["cells"].groupBy("cell")).applyInArrow(lambda k, x, y: _answered(k, x, y, fixed), ANSWERS)
    scored = answers.groupBy("block").applyInArrow(_assembled, SCORED)
    return scored.select(F.nullif("doc_id", last).alias("doc_id"), "n_tokens", "n_known", F.lit(m["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(F.coalesce(remainder(F.col("doc_id"), 5) != 1, F.lit(True))).select("text")
    scored = score(docs, *fit(train))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False)).alias("held_out"), *scored.columns[1:])
