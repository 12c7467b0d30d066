"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is what lies between line feeds; it is compared by its words. Lines are duplicates if their words are the same,
or, where both have at least ``min_words`` words, if one edit (a word added, dropped or changed) turns one into the
other. A line is removed if an earlier line duplicates it; the order is document id, then place. Every copy of a line
is judged on the input, not on what is left. Lines without words stay.

1. Lines whose first hash no other line has are told apart by a count of hashes alone; the others fall together by a
   pre-aggregated grouping on 128 bits that keeps the earliest.
2. An edit spares the first or the last half of the words of the shorter line (of both, where they have as many), so only
   lines that share such a half with another line go on. This is exact. Their texts are taken from the documents again.
3. Those left make all variants within the bound: themselves, and themselves without their i-th word, as hashed keys made
   from a running XOR inside the row, so a line of n words costs some n steps. Changed words meet at one key of both
   lines' i-th variants, added words where a whole line equals a variant. A count of hashed keys and places finds the
   variants that another line has too; only they, and those that may equal a whole line, go through joins.
4. In a bucket of changed words all are checked against the earliest; a whole line against each variant that equals it.
   So a bucket of n lines makes n pairs. The edit distance of each pair is verified on its words.

Rows that no join can hit are kept out of its shuffle by broadcast maps of a fixed size (``bit_map``). A map hits some rows
too many, more of them the fuller it is, so each is followed by the exact join or grouping, and results don't depend on it.

No step expands a bucket into its pairs, and no join has more than one row of a key on its smaller side. Both sides of
the joins by line, half and variant come straight from a shuffle, so that a key of many rows is split by adaptive
execution.

Nulls: a null text has no lines and stays null. Rows without an id are told apart by 94 bits of their text's hashes and
come after all ids below 2^62, in order of those. Rows with one id and one text are the same line and don't remove each
other; rows with one id and different texts are kept apart by 32 bits, in order of those. Within a document the earlier
line stays. Texts and lines are taken whole, however long. An empty table gives an empty result. Carried columns keep
their values; the operator's own have no clash, since only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import materialize

SPACES = "[\x09-\x0d\x20]+"
#: What must be made one space, or none at an end, before words can be told apart by single spaces.
UNEVEN = "[\x09-\x0d]|  |^ | $"
MIN_WORDS = 8
#: Words whose running XOR is taken in one array.
RUN = 64


def even(line: Column) -> Column:
    """The line's words with one space between them; most lines are so already."""
    return F.when(line.rlike(UNEVEN), F.trim(F.regexp_replace(line, SPACES, " "))).otherwise(line)


def running_xor(values: Column) -> Column:
    """The XOR of an array's values up to each place, in runs of RUN values, so that long arrays aren't copied for each."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    upto = lambda xs: F.aggregate(xs, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, last(acc).bitwiseXOR(x)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: upto(F.slice(values, k * RUN + 1, F.lit(RUN))))
    before = F.concat(F.array(F.lit(0).cast("long")), upto(F.transform(runs, last)))
    return F.flatten(F.zip_with(runs, before, lambda run, b: F.transform(F.coalesce(run, F.array().cast("array<bigint>")), lambda x: x.bitwiseXOR(b))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The order of a row's document: its id, or a hash from 2^62 on, and a hash that tells rows of one id apart."""
    late = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text_col), 2))
    return docs.withColumns({"own_id": F.coalesce(F.col(id_col).cast("long"), late), "own_hash": F.hash(F.col(text_col)).cast("long")})


#: Bits of the map by which rows that no join can hit are kept out of its shuffle: 8 MB, whatever the size of the tables.
MAP_BITS = 1 << 26
#: Bits in a row of the map.
MAP_ROW = 1 << 10


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS))


def bit_map(rows: DataFrame, *keys: str) -> DataFrame:
    """``(bucket, bits)``: a map of the keys' hashes with at most MAP_BITS / MAP_ROW rows of 16 longs."""
    at, per = _slot(*keys) + 1, (1 << 15) // MAP_ROW  # Spark counts places from 1
    out = rows.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = out.select("block", "bits", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("part"))
    out = out.select(((F.col("block") - 1) * per + F.col("part")).alias("bucket"), F.substring("bits", F.col("part") * (MAP_ROW // 8) + 1, F.lit(MAP_ROW // 8)).alias("bits"))
    four = lambda k: F.conv(F.hex(F.substring("bits", k + 1, 4)), 16, 10).cast("long")
    return out.select("bucket", F.array(*[F.shiftleft(four(k), 32).bitwiseOR(four(k + 4)) for k in range(0, MAP_ROW // 8, 8)]).alias("bits"))


def marked(rows: DataFrame, map_: DataFrame, *keys: str) -> DataFrame:
    """The rows with a column ``hit``: false for none whose keys are in the map; its size is bounded, so it is broadcast."""
    slot = _slot(*keys)
    # the eight bytes of a long are in order from its highest, the bits of a byte from its lowest
    long = F.get("bits", F.shiftright(slot, 6).bitwiseAND(MAP_ROW // 64 - 1).cast("int"))
    bit = F.call_function("shiftrightunsigned", long, slot.bitwiseAND(63).bitwiseXOR(F.lit(56)).cast("int")).bitwiseAND(1)
    out = rows.withColumn("bucket", F.shiftright(slot, MAP_ROW.bit_length() - 1)).join(F.broadcast(map_), "bucket", "left")
    return out.withColumn("hit", F.coalesce(bit == 1, F.lit(False))).drop("bucket", "bits")


def _split(text_col: str) -> Column:
    """The lines of a text with single spaces; a text that is even as a whole is not looked at line by line."""
    parts = F.split(F.col(text_col), "\n", -1)
    ragged = F.col(text_col).startswith(" ") | F.col(text_col).endswith(" ")
    for x in ("  ", " \n", "\n ", "\t", "\v", "\f", "\r"):
        ragged |= F.contains(F.col(text_col), F.lit(x))
    return F.when(ragged, F.transform(parts, even)).otherwise(parts)


def _exploded(keyed: DataFrame, text_col: str) -> DataFrame:
    """``(own_id, place, line)``: place holds the row's hash and the line's number, line its words with single spaces."""
    lines = keyed.select("own_id", "own_hash", F.posexplode(_split(text_col)).alias("pos", "line"))
    return lines.select("own_id", F.shiftleft("own_hash", 32).bitwiseOR(F.col("pos").cast("long")).alias("place"), "line")


def _halves(n: Column) -> Column:
    """Hashes of the first and the last half of a line's n words, and of those of the lines one word shorter that it may extend."""
    part = lambda tag, m, words: F.xxhash64(F.lit(tag), m, F.call_function("substring_index", F.col("line"), F.lit(" "), words))
    level = lambda m: [part("head", m, F.shiftright(m, 1)), part("tail", m, F.shiftright(m, 1) - m)]
    return F.array(*level(n), *level(n - 1))


def with_variants(picked: DataFrame) -> DataFrame:
    """The rows with ``whole``, the hash of their words, and ``keys``, that of the words without the i-th for each i.

    A hash is the XOR of the words' at their places. The i-th key takes what is after the i-th word one place earlier: the
    XOR of all words one place earlier, but for the i-th, and of both hashes of each word before it."""
    xor = lambda x, y: x.bitwiseXOR(y)
    out = picked.withColumn("here", F.transform("words", lambda w, i: F.xxhash64(w, i))).withColumn("before", F.transform("words", lambda w, i: F.xxhash64(w, i - 1)))
    out = out.withColumn("turned", running_xor(F.zip_with("here", "before", xor))).withColumn("all", F.aggregate("before", F.lit(0).cast("long"), xor))
    keys = F.transform("before", lambda b, i: b.bitwiseXOR(F.col("all")).bitwiseXOR(F.when(i > 0, F.get("turned", i - 1)).otherwise(F.lit(0).cast("long"))))
    return out.select(*picked.columns, F.col("all").bitwiseXOR(F.element_at("turned", -1)).alias("whole"), keys.alias("keys"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether at most one word is added, dropped or changed between two arrays; the first is not the longer."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    same = F.size(a) == F.size(b)
    rest = lambda x, i: F.slice(x, i, F.greatest(F.size(x) - i + 1, F.lit(0)))
    return (first == 0) | (same & (rest(a, first + 1) == rest(b, first + 1))) | ((F.size(a) + 1 == F.size(b)) & (rest(a, first) == rest(b, first + 1)))


def duplicate_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``(own_id, place)`` of each line that an earlier line duplicates; place holds the row's hash and the line's number."""
    keyed = _keyed(docs.select(id_col, text_col), id_col, text_col)
    lead = F.min(F.struct("own_id", "place")).alias("low")
    words_in = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = _exploded(keyed, text_col).where("line <> ''").withColumn("n", words_in).select(
        "own_id", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"), F.when(F.col("n") >= min_words, _halves(F.col("n"))).alias("halves"))
    lines = materialize(lines, "lines")

    # a line whose first hash is no other's is the earliest of its kind
    repeated = materialize(lines.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "repeated")
    lines = marked(lines, bit_map(repeated, "h1"), "h1")
    kinds = lines.where("hit").groupBy("h1", "h2").agg(lead, F.first("halves").alias("halves"), F.count("*").alias("copies"))
    kinds = materialize(kinds.select("h1", "h2", "low.*", "halves", "copies"), "kinds")
    copied = kinds.where("copies > 1").select("h1", "h2", F.col("own_id").alias("low_id"), F.col("place").alias("low_place"))
    equal = lines.where("hit").select("h1", "h2", "own_id", "place").join(copied, ["h1", "h2"]).where("own_id > low_id or own_id = low_id and place > low_place").select("own_id", "place")

    earliest = lines.where("not hit").select("own_id", "place", "halves").unionByName(kinds.select("own_id", "place", "halves"))
    halves = earliest.where("halves is not null").select("own_id", "place", F.explode("halves").alias("half"))
    shared = materialize(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "shared-halves")
    halves = marked(halves, bit_map(shared, "half"), "half").where("hit")
    chosen = materialize(halves.join(shared, "half").select("own_id", "place").distinct(), "chosen")
    texts = keyed.select("own_id", "own_hash", F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    texts = texts.select("own_id", F.shiftleft("own_hash", 32).bitwiseOR(F.col("pos").cast("long")).alias("place"), "line")
    texts = marked(texts, bit_map(chosen, "own_id", "place"), "own_id", "place").where("hit").drop("hit")
    picked = texts.join(chosen, ["own_id", "place"]).select("own_id", "place", "line").distinct()
    picked = with_variants(picked.select("own_id", "place", F.split(even(F.col("line")), " ").alias("words")))
    picked = materialize(picked, "picked")

    # only variants that another line may have too, or be as a whole, go on
    n = F.size("keys")
    whole = picked.select("own_id", "place", n.alias("n"), F.col("whole").alias("key"))
    variants = picked.select("own_id", "place", n.alias("n"), F.posexplode("keys").alias("i", "key")).withColumn("less", F.col("n") - 1)
    spots = variants.select(F.xxhash64("key", "n", "i").alias("spot")).groupBy("spot").agg(F.count("*").alias("n")).where("n > 1").select("spot")
    spots = materialize(spots, "spots")
    variants = marked(variants.withColumn("spot", F.xxhash64("key", "n", "i")), bit_map(spots, "spot"), "spot").drop("spot").withColumnRenamed("hit", "crowded")
    variants = marked(variants, bit_map(whole, "key", "n"), "key", "less").withColumnRenamed("hit", "extends")
    variants = materialize(variants.where("crowded or extends"), "variants")

    crowded = variants.where("crowded")
    crowds = crowded.groupBy("key", "n", "i").agg(lead, F.count("*").alias("size")).where("size > 1").select("key", "n", "i", F.col("low.own_id").alias("a_id"), F.col("low.place").alias("a_place"))
    crowds = materialize(crowds, "crowds")
    changed = crowded.join(crowds, ["key", "n", "i"]).select("a_id", "a_place", F.col("own_id").alias("b_id"), F.col("place").alias("b_place"))
    added = variants.where("extends").select("key", F.col("less").alias("n"), F.col("own_id").alias("b_id"), F.col("place").alias("b_place")).join(whole.withColumnsRenamed({"own_id": "a_id", "place": "a_place"}), ["key", "n"])
    pairs = changed.unionByName(added.select("a_id", "a_place", "b_id", "b_place")).where("a_id <> b_id or a_place <> b_place").distinct()
    pairs = materialize(pairs, "pairs")
    side = lambda x: marked(picked.select(F.col("own_id").alias(f"{x}_id"), F.col("place").alias(f"{x}_place"), F.col("words").alias(f"{x}_words")), bit_map(pairs, f"{x}_id", f"{x}_place"), f"{x}_id", f"{x}_place").where("hit").drop("hit")
    near = pairs.join(side("a"), ["a_id", "a_place"]).join(side("b"), ["b_id", "b_place"]).where(within_one_edit(F.col("a_words"), F.col("b_words")))
    later = F.when((F.col("a_id") > F.col("b_id")) | (F.col("a_id") == F.col("b_id")) & (F.col("a_place") > F.col("b_place")), F.struct(F.col("a_id").alias("own_id"), F.col("a_place").alias("place"))).otherwise(F.struct(F.col("b_id").alias("own_id"), F.col("b_place").alias("place")))
    return equal.unionByName(near.select(later.alias("x")).select("x.*"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: ``carry`` columns, id, what is left of the text, n_lines, n_removed and removed (line numbers from 0)."""
    carry = [c for c in carry if c not in (id_col, text_col)]
    gone = duplicate_lines(docs, id_col, text_col, min_words)
    gone = gone.groupBy("own_id", F.shiftright("place", 32).alias("own_hash")).agg(F.sort_array(F.collect_set(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"))).alias("removed"))
    gone = materialize(gone, "removed")
    keyed = marked(_keyed(docs.select(*carry, id_col, text_col), id_col, text_col), bit_map(gone, "own_id", "own_hash"), "own_id", "own_hash")
    # documents that keep all lines don't go through the join's shuffle
    both = keyed.where("hit").join(gone, ["own_id", "own_hash"], "left").unionByName(keyed.where("not hit").withColumn("removed", F.lit(None).cast("array<int>"))).withColumn("all", F.split(text_col, "\n", -1))
    # the removed numbers are in order, so what lies between two of them is kept whole
    ends = F.concat("removed", F.array(F.size("all")))
    kept = F.flatten(F.transform(ends, lambda end, k: F.slice("all", F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, k)) + F.when(k == 0, F.lit(1)).otherwise(F.lit(2)), end - F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, k) + 1))))
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return both.select(*carry, F.col(id_col).cast("long").alias(id_col), text.alias(text_col), F.when(F.col(text_col).isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
