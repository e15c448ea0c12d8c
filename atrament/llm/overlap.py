"""Problem 4: same or near-same records across splits.

Method: segments and bit fingerprints, both of which lose no pair. Each distinct folded reference of train is cut into k + 1
disjoint pieces, where k edits are allowed at most. Of these let the i-th be the first (from 0) up to whose end there are i
edits at most: these i edits lie before it, so it stands whole in the other text, at most i places away, and counted from the
ends of both texts at most k - i places away. So few places are tried. Pieces have 5 to 7 characters, as many as the text's
length has room for. Of all choices of such pieces the one is taken that val and test texts hold least often, counted by the
places to be tried.

Each piece carries fingerprints of its text: 128 bits count letters, of which k edits change 2 k at most, and 256 bits count
neighbouring letters, of which they change 4 k. Pieces of all texts are brought together by a shuffle and sorted; of each train
piece only the slice of places is compared, from the beginning or the end of the texts, whichever slice holds less. Pairs
within both Hamming radii are kept; the edit distance of the folded texts decides. Equal texts are one class and meet without
fingerprints.

Defined cases: null, short (fewer than MIN_CHARS letters and digits) and unassigned references have no pair; repeated
deliveries count once, in their current state; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrament.functions.fold import current_records, fold, split_name
from atrament.session import Scratch, table

MIN_CHARS = 20
#: Largest edit distance in 100 characters of the longer text.
PERCENT = 12
#: From which length of a text on its pieces have how many characters, so that one more piece than the edits allowed has room. Bins that count pieces; parts in which pieces are met one after the other, so that less lies on disk at once.
PIECES, PIECE_BINS, ROUNDS = [(MIN_CHARS, 5), (33, 6), (156, 7)], 1 << 18, 4
#: Pieces that are compared at once, at least, and pairs of them, about.
TOGETHER, AT_ONCE = 100_000, 1 << 19
#: Slices from this length on are compared one by one.
SLICE = 1500
#: Texts beyond this length are cut into pieces from their beginning on, whatever the pieces' counts.
LONG = 2000
#: The columns of fingerprints.
BITS_OF = ("letters0", "letters1", "pair0", "pair1", "pair2", "pair3")
_BIGINTS = ", ".join(f"{c} bigint" for c in BITS_OF)


def most_edits(lens: np.ndarray) -> np.ndarray:
    """Edits at most between a text of this length and any longer one."""
    return lens * 100 // (100 - PERCENT) * PERCENT // 100


def piece_size(lens: np.ndarray) -> np.ndarray:
    """Characters of the pieces of a train text of this length."""
    return np.array([q for _, q in PIECES])[np.searchsorted([n for n, _ in PIECES], lens, side="right") - 1]


def meets_size(lens: np.ndarray, q: int) -> np.ndarray:
    """Whether some train text that a text of this length may be near to has pieces of q characters."""
    least, most = lens - lens * PERCENT // 100, lens + most_edits(lens)
    return (piece_size(np.maximum(least, MIN_CHARS)) <= q) & (piece_size(most) >= q)


def _letters(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a row each, filled up with 0; the lengths."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    a = np.zeros((len(texts), lens.max()), np.uint32)
    a[np.arange(a.shape[1]) < lens[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return a, lens


def _pieces(a: np.ndarray, q: int) -> np.ndarray:
    """A hash of the piece of q characters that begins at each place."""
    h = np.full((len(a), a.shape[1] - q + 1), q, np.uint64)
    for i in range(q):
        h = h * np.uint64(1_000_003) + a[:, i : i + h.shape[1]]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32)


def _bin(h: np.ndarray) -> np.ndarray:
    return h >> np.uint32(32 - PIECE_BINS.bit_length() + 1)


def rare_pieces(h: np.ndarray, lens: np.ndarray, q: int, held: np.ndarray) -> np.ndarray:
    """Where the pieces of each text begin, most_edits + 1 of them (then -1): disjoint, the least in the sum of held by bin
    times the places at which the piece is tried."""
    n, wide, need = len(h), h.shape[1], most_edits(lens) + 1
    if wide > LONG:  # any disjoint pieces will do
        r = np.arange(int(need.max()))
        return np.where(r < need[:, None], r * q, -1)
    cost = np.where(np.arange(wide) <= (lens - q)[:, None], held[_bin(h)], np.float32(1e30))
    best, taken = np.zeros((n, wide + q), np.float32), []  # least sum within the first places
    for r in range(int(need.max())):
        places = (2 * np.maximum(np.minimum(r, need - 1 - r), 0) + 1).astype(np.float32)[:, None]
        new = np.full((n, wide + q), np.float32(1e30))
        new[:, q:] = np.minimum(best[:, :wide] + cost * places, np.float32(1e30))
        best = np.minimum.accumulate(new, axis=1)
        taken.append(new[:, q:] <= best[:, q - 1 : -1])  # the piece that ends here is as good as any before
    out, end, row = np.full((n, len(taken)), -1, np.int64), lens.copy(), np.arange(n)
    for r in range(len(taken) - 1, -1, -1):
        on = need > r
        last = np.maximum.accumulate(np.where(taken[r], np.arange(wide), -1), axis=1)
        at = last[row, np.clip(end - q, 0, wide - 1)]
        out[on, r] = at[on]
        end = np.where(on, at, end)
    return out


def letter_bits(a: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits per text that differ in twice the edits at most: 32 groups of letters, the count of each in a
    ring of four bits where the next count differs in one."""
    row, col = np.nonzero(a)
    n = np.bincount(row * 32 + (a[row, col] & 31), minlength=len(a) * 32).reshape(-1, 32)
    four = np.array([0, 1, 3, 7, 15, 14, 12, 8], np.uint8)[n & 7]
    return (four[:, ::2] | four[:, 1::2] << 4).view(np.int64)


def pair_bits(texts: pd.Series) -> np.ndarray:
    """Four numbers of 64 bits per text: for each of 256 groups of neighbouring letters whether their count is odd. An edit changes four at most."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (a[:-1] * np.uint64(0x9E3779B1) + a[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
    row = np.repeat(np.arange(len(lens)), lens)
    inside = row[:-1] == row[1:]
    odd = (np.bincount((row[:-1] * 256 + h.astype(np.int64))[inside], minlength=len(lens) * 256) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(lens), 256), axis=1).view(np.int64)


def _count_pieces(batches):
    n = np.zeros(PIECE_BINS, np.int64)
    for b in batches:
        for i in range(0, len(b), 512):
            a, lens = _letters(b["text"].iloc[i : i + 512])
            for _, q in PIECES:
                on = meets_size(lens, q)
                if on.any():
                    h = _pieces(a[on], q)
                    n += np.bincount(_bin(h[np.arange(h.shape[1]) <= (lens[on] - q)[:, None]]), minlength=PIECE_BINS)
    at = np.nonzero(n)[0]
    yield pd.DataFrame({"bin": at.astype(np.int32), "n": n[at]})


def references(records: DataFrame) -> DataFrame:
    """Current records with split and folded reference, long enough to count."""
    rows = current_records(records.where("id is not null"), ["split", "source_page", "reference"])
    return rows.select("id", "source_page", split_name(F.col("split")).alias("split"), fold(F.col("reference")).alias("text")).where(f"split is not null and char_length(text) >= {MIN_CHARS}")


def cut_texts(texts: DataFrame) -> DataFrame:
    """texts (cls, train, held, text), a kept table, to (num, cls, train, held, text, spots, letters0, letters1, pair0 to pair3): where the
    pieces of a train text begin, and the text's fingerprints. num is a dense number: it takes fewer bytes than cls in the many rows of pieces."""
    held = np.zeros(PIECE_BINS, np.float32)
    got = texts.where("held").select("text").mapInPandas(_count_pieces, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # PIECE_BINS rows at most
    held[got["bin"].to_numpy()] = got["n"].to_numpy()
    counts = texts.sparkSession.sparkContext.broadcast(held + np.float32(0.01))

    def run(batches):
        for b in batches:
            for part in _alike(b):
                a, lens = _letters(part["text"])
                sizes, spots = piece_size(lens), [[]] * len(part)
                for _, q in PIECES:
                    on = np.nonzero((sizes == q) & part["train"].to_numpy(bool))[0]
                    if len(on):
                        for i, at in zip(on, rare_pieces(_pieces(a[on], q), lens[on], q, counts.value)):
                            spots[i] = at[at >= 0].astype(np.int32)
                bits = np.concatenate([letter_bits(a), pair_bits(part["text"])], axis=1)
                yield part.assign(spots=spots, **{c: bits[:, k] for k, c in enumerate(BITS_OF)})

    cut = texts.select("cls", "train", "held", "text").mapInPandas(run, f"cls binary, train boolean, held boolean, text string, spots array<int>, {_BIGINTS}")
    return cut.withColumn("num", F.monotonically_increasing_id())


def _alike(b: pd.DataFrame):
    """Parts of a batch with texts of like length, as rows are filled up to the longest; few if they are long."""
    lens = b["text"].str.len().to_numpy()
    order = lens.argsort(kind="stable")
    i = 0
    while i < len(b):
        n = 256
        while n > 1 and n * lens[order[min(i + n, len(b)) - 1]] > 100_000:
            n //= 2
        yield b.iloc[order[i : i + n]]
        i += n


def _rows_of_pieces(part_of: int):
    """Of texts (num, train, held, text, spots, fingerprints) the pieces of one part: (piece and place, num, which of the
    text's pieces and the text's length, fingerprints). Of a val or test text the pieces at all places, with -1 for which."""

    def rows(part, lens, piece, own, at, nth):
        now = piece % ROUNDS == part_of
        piece, at, nth, own = piece[now].astype(np.int64), at[now], nth[now], own[now]
        return pd.DataFrame({"key": piece << 32 | at, "num": part["num"].to_numpy()[own], "info": nth << 32 | lens[own]} | {c: part[c].to_numpy()[own] for c in BITS_OF})

    def run(batches):
        for b in batches:
            for part in _alike(b):
                a, lens = _letters(part["text"])
                sizes, spots, train, held = piece_size(lens), part["spots"].to_numpy(), part["train"].to_numpy(bool), part["held"].to_numpy(bool)
                for _, q in PIECES:
                    on = np.nonzero(train & (sizes == q))[0]
                    if len(on):
                        n = np.fromiter(map(len, spots[on]), np.int64, len(on))
                        row, at = np.repeat(np.arange(len(on)), n), np.concatenate(spots[on]).astype(np.int64)
                        yield rows(part, lens, _pieces(a[on], q).view(np.int32)[row, at], on[row], at, np.arange(len(row)) - np.repeat(n.cumsum() - n, n))
                    on = np.nonzero(held & meets_size(lens, q))[0]
                    if len(on):
                        h = _pieces(a[on], q).view(np.int32)
                        row, at = np.nonzero(np.arange(h.shape[1]) <= (lens[on] - q)[:, None])
                        yield rows(part, lens, h[row, at], on[row], at, np.full(len(row), -1))

    return run


def meeting(key: np.ndarray, num: np.ndarray, info: np.ndarray, bits: np.ndarray):
    """Pairs (num of the train text, num of the other) whose pieces, sorted by key, are equal, not too far apart, and have
    fingerprints (a row of BITS_OF each) within the radius."""
    nth = info >> 32
    t, h = np.nonzero(nth >= 0)[0], np.nonzero(nth < 0)[0]
    at, lens = key & 0xFFFFFFFF, info & 0xFFFFFFFF
    base, tail, most = key - at, lens - at, most_edits(lens)
    back = h[(base[h] + tail[h]).argsort(kind="stable")]
    slices = []
    for order, places, where, away in ((h, key[h], at[t], nth[t]), (back, base[back] + tail[back], tail[t], most[t] - nth[t])):
        low = np.searchsorted(places, base[t] + np.maximum(where - away, 0))
        slices.append((order, low, np.searchsorted(places, base[t] + where + away, side="right") - low))
    fewer = slices[1][2] < slices[0][2]
    for (order, low, n), on in zip(slices, (~fewer, fewer)):
        on &= n > 0
        own = t[on]
        for x, y in _within(bits[own, :2], np.ascontiguousarray(bits[order, :2].T), 2 * most[own], low[on], n[on]):
            a, b = own[x], order[y]
            k = np.maximum(lens[a], lens[b]) * PERCENT // 100
            good = (np.abs(at[b] - at[a]) <= nth[a]) & (np.abs(tail[b] - tail[a]) <= k - nth[a]) & (num[a] != num[b])
            a, b, k = a[good], b[good], k[good]
            good = np.bitwise_count(bits[a, 2:] ^ bits[b, 2:]).sum(axis=1, dtype=np.int64) <= 4 * k
            if good.any():
                yield num[a[good]], num[b[good]]


def _within(mine: np.ndarray, theirs: np.ndarray, room: np.ndarray, low: np.ndarray, n: np.ndarray):
    """Rows of mine and columns of theirs, of the n from low on, that differ in room bits at most."""
    x, y, held = [], [], 0
    room = np.minimum(room, 255).astype(np.uint8)  # 128 bits are compared
    longest = int(n.max()) if len(n) else 0
    word, one, two = np.empty(longest, np.uint64), np.empty(longest, np.uint8), np.empty(longest, np.uint8)  # new arrays would cost more than the counts
    for i in np.nonzero(n >= SLICE)[0]:
        m, at = n[i], slice(low[i], low[i] + n[i])
        np.bitwise_count(np.bitwise_xor(theirs[0, at], mine[i, 0], out=word[:m]), out=one[:m])
        np.bitwise_count(np.bitwise_xor(theirs[1, at], mine[i, 1], out=word[:m]), out=two[:m])
        got = np.flatnonzero(np.add(one[:m], two[:m], out=one[:m]) <= room[i])
        x.append(np.full(len(got), i))
        y.append(got + low[i])
        held += len(got)
        if held >= AT_ONCE:
            yield np.concatenate(x), np.concatenate(y)
            x, y, held = [], [], 0
    if held:
        yield np.concatenate(x), np.concatenate(y)
    few = np.nonzero(n < SLICE)[0]
    mine, room, low, n = np.ascontiguousarray(mine[few].T), room[few], low[few], n[few]
    for i, j in _chunks(n):
        m = n[i:j]
        y = np.arange(m.sum()) + np.repeat(low[i:j] - m.cumsum() + m, m)
        diff = np.bitwise_count(np.repeat(mine[0, i:j], m) ^ theirs[0][y]) + np.bitwise_count(np.repeat(mine[1, i:j], m) ^ theirs[1][y])
        on = np.flatnonzero(diff <= np.repeat(room[i:j], m))
        x = i + np.searchsorted(m.cumsum(), on, side="right")
        yield few[x], y[on]


def _chunks(n: np.ndarray):
    """Ranges of n with sums of about AT_ONCE."""
    upto, i = n.cumsum(), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, side="right")))
        yield i, j
        i = j


def _meet(batches):
    """Pieces sorted by key to pairs of num; no piece is cut in two."""

    def pairs(parts):
        p = pd.concat(parts)
        for x, y in meeting(p["key"].to_numpy(), p["num"].to_numpy(), p["info"].to_numpy(), np.stack([p[c].to_numpy() for c in BITS_OF], axis=1).view(np.uint64)):
            yield pd.DataFrame({"num_t": x, "num_h": y})

    parts, n = [], 0
    for b in batches:
        if not len(b):
            continue
        if n >= TOGETHER:
            last = parts[-1]["key"].to_numpy()[-1] >> 32
            cut = int((b["key"].to_numpy() >> 32 == last).sum())
            if cut < len(b):
                yield from pairs([*parts, b.iloc[:cut]])
                parts, n, b = [], 0, b.iloc[cut:]
        parts.append(b)
        n += len(b)
    if parts:
        yield from pairs(parts)


def piece_candidates(cut: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """cut_texts, kept, to kept tables of pairs (num_t, num_h), among them all within PERCENT."""
    out = []
    for r in range(ROUNDS):
        rows = cut.select("num", "train", "held", "text", "spots", *BITS_OF).mapInPandas(_rows_of_pieces(r), f"key bigint, num bigint, info bigint, {_BIGINTS}")
        near = rows.repartition(F.shiftright("key", 32)).sortWithinPartitions("key").mapInPandas(_meet, "num_t bigint, num_h bigint")
        out.append(scratch.keep(near))
        del rows, near
        scratch.release()
    return out


def near_classes(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """classes (cls, train, held, text), one row per distinct text, to pairs (cls_t, cls_h, distance) of different texts:
    one with train records, the other with val or test records."""
    cut = scratch.keep(cut_texts(classes))
    scratch.drop(classes)
    first, *others = piece_candidates(cut, scratch)
    for more in others:
        first = first.union(more)
    side = lambda x: cut.where("train" if x == "t" else "held").select(*[F.col(c).alias(f"{c}_{x}") for c in ("num", "cls", "text")])
    near = first.distinct().join(side("t"), "num_t").join(side("h"), "num_h")  # a pair may be met in several ways
    most = F.expr(f"cast(floor(greatest(char_length(text_t), char_length(text_h)) * {PERCENT} / 100) as int)")
    near = near.withColumn("most", most).withColumn("distance", F.expr("levenshtein(text_t, text_h, most)"))
    return near.where("distance >= 0").select("cls_t", "cls_h", "distance")


def class_links(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Records (id, source_page, split, cls) and links (cls_t, cls_h, distance) of classes of equal texts: one with train
    records, the other, or the same, with val or test records."""
    full = scratch.keep(references(records).withColumn("cls", F.unhex(F.md5(F.col("text").cast("binary")))))
    texts = scratch.keep(full.groupBy("text").agg(F.first("cls").alias("cls"), F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") != "train").alias("held")))
    rows = scratch.keep(full.select("id", "source_page", "split", "cls"))
    scratch.drop(full)
    near = near_classes(texts, scratch)
    same = rows.groupBy("cls").agg(F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") != "train").alias("held")).where("train and held")
    return rows, near.union(same.select(F.col("cls").alias("cls_t"), F.col("cls").alias("cls_h"), F.lit(0).alias("distance")))


def overlaps(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (id_t, id_h, split, source_page, distance): a train record and a val or test record, with the latter's split and source."""
    rows, links = class_links(records, scratch)
    train = rows.where("split = 'train'").select(F.col("id").alias("id_t"), F.col("cls").alias("cls_t"))
    held = rows.where("split <> 'train'").select(F.col("id").alias("id_h"), F.col("cls").alias("cls_h"), "split", "source_page")
    return links.join(held, "cls_h").join(train, "cls_t").select("id_t", "id_h", "split", "source_page", "distance")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = overlaps(table(spark, sf_dir, "printed_replay_geometry"), Scratch(spark, "overlap"))
    return got.select(F.least("id_t", "id_h").alias("id_a"), F.greatest("id_t", "id_h").alias("id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source page: its records that overlap with train, the pairs, and how many of these are exact. Counted
    from classes of equal texts: their pairs of records are not made."""
    rows, links = class_links(table(spark, sf_dir, "printed_replay_geometry"), Scratch(spark, "overlap"))
    train = rows.where("split = 'train'").groupBy(F.col("cls").alias("cls_t")).agg(F.count(F.lit(1)).alias("n"))
    each = links.join(train, "cls_t").groupBy(F.col("cls_h").alias("cls")).agg(F.sum("n").alias("pairs"), F.coalesce(F.sum(F.when(F.col("distance") == 0, F.col("n"))), F.lit(0)).alias("exact"))
    held = rows.where("split <> 'train'").groupBy("cls", "split", "source_page").agg(F.count(F.lit(1)).alias("m"))
    got = held.join(each, "cls").groupBy("split", "source_page")
    return got.agg(F.sum("m").alias("records"), F.sum(F.col("m") * F.col("pairs")).alias("pairs"), F.sum(F.col("m") * F.col("exact")).alias("exact"))


#: Codes by weighted min-hash over character trigrams, for texts that need not all be met; no query uses them, as pieces meet all that they met.
GRAM, BINS, BLOCKS, ROWS, BITS, SEED = 3, 1 << 16, 30, 4, 64, 20240229


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all trigrams of the texts in one array, and where each text begins in it. No text is shorter than GRAM."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(a) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(1_000_003) + a[i : len(a) - GRAM + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum(lens)
    inside = np.ones(len(h), bool)
    for i in range(1, GRAM):
        inside[(ends - i)[:-1]] = False  # these reach into the next text
    return (h >> np.uint64(48))[inside].astype(np.int64), np.concatenate([[0], np.cumsum(lens - GRAM + 1)[:-1]])


class Coder:
    """Codes of texts, by a table of exponential draws per bin and hash, divided by the bin's weight."""

    def __init__(self, df: np.ndarray, n: int):
        self.df, self.n, self.draws = df, n, None

    def __getstate__(self):
        return {"df": self.df, "n": self.n, "draws": None}

    def __call__(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        if self.draws is None:
            weight = np.maximum(np.log((self.n + 1) / (self.df + 1)), 0) + 1e-3  # a bin may occur more often than there are texts
            rng = np.random.Generator(np.random.PCG64(SEED))
            self.draws = rng.standard_exponential((BINS, BLOCKS * ROWS), dtype=np.float32) / weight[:, None].astype(np.float32)
        bins, at = grams(texts)
        least = np.minimum.reduceat(self.draws[bins], at, axis=0).view(np.uint32).astype(np.uint64)
        mixed = least.copy()
        mixed ^= mixed >> np.uint64(15)
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        blocks = np.tile(np.arange(1, BLOCKS + 1, dtype=np.uint64), (len(texts), 1))
        for r in range(ROWS):
            blocks = (blocks ^ least[:, r::ROWS]) * np.uint64(0xC4CEB9FE1A85EC53)
            blocks ^= blocks >> np.uint64(31)
        bits = (mixed[:, :BITS] >> np.uint64(40)) & np.uint64(1)
        return (blocks >> np.uint64(32)).astype(np.int64), (bits << np.arange(BITS, dtype=np.uint64)).sum(1).astype(np.int64)


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

#: The twin compares all pairs of texts, which only small tables bear.
_COUNTS = ", ".join(f"length(t) - length(replace(t, '{c}', '')) AS n_{c}" for c in "abcdefghijklmnoprstuwyz")
_APART = " + ".join(f"abs(a.n_{c} - b.n_{c})" for c in "abcdefghijklmnoprstuwyz")  # an edit changes two counts by one at most
_PAIRS = f"""WITH cur AS (SELECT id, source_page, regexp_replace(translate(strip_accents(lower(reference)), 'ł', 'l'), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t, CASE WHEN lower(trim(split, ' \n\t\r')) IN ('valid', 'validation') THEN 'val' ELSE lower(trim(split, ' \n\t\r')) END AS split FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM printed_replay_geometry) WHERE rn = 1),
r AS (SELECT * FROM cur WHERE length(t) >= 20 AND split IN ('train', 'val', 'test')), a AS MATERIALIZED (SELECT t, {_COUNTS} FROM (SELECT DISTINCT t FROM r WHERE split = 'train')), b AS MATERIALIZED (SELECT t, {_COUNTS} FROM (SELECT DISTINCT t FROM r WHERE split <> 'train')),
c AS MATERIALIZED (SELECT a.t AS x, b.t AS y FROM a JOIN b ON length(a.t) BETWEEN length(b.t) * 0.88 - 1 AND length(b.t) / 0.88 + 1 WHERE ({_APART}) * 100 <= 24 * greatest(length(a.t), length(b.t))),
j AS (SELECT x, y FROM c WHERE levenshtein(x, y) * 100 <= 12 * greatest(length(x), length(y))), p AS (SELECT u.id AS id_t, v.id AS id_h, v.split, v.source_page, x = y AS same FROM j JOIN r u ON u.t = j.x AND u.split = 'train' JOIN r v ON v.t = j.y AND v.split <> 'train')
"""
SQL = {"p4_found": _PAIRS + "SELECT least(id_t, id_h) AS id_a, greatest(id_t, id_h) AS id_b FROM p", "p4_report": _PAIRS + "SELECT split, source_page, count(DISTINCT id_h) AS records, count(*) AS pairs, count(*) FILTER (same) AS exact FROM p GROUP BY split, source_page"}
