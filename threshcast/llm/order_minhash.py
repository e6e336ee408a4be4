"""Order MinHash fingerprints from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threshcast.llm.base import stored

#: A text is read as pieces of words, at most this many characters each.
PIECE = 12
#: Of two neighbouring characters in a longer run one in so many ends a piece; runs are looked at
#: in parts of so many characters.
_ENDS, _RUN = 4, 4096
#: Bits of a piece's place in the text, and of the bucket number.
_PLACE, _BUCKET = 24, 6
_REST = 63 - _BUCKET - _PLACE
BUCKETS = 1 << _BUCKET


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def pieces_of(text: Column) -> Column:
    """Words, and the pieces of longer runs. A piece of a run ends where a hash of the last two
    characters says so, or after ``PIECE`` characters, so an inserted character changes the pieces
    around it and no others, also in texts without blanks."""
    whole = F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]{{1,{_RUN}}}"), F.lit(0))

    def cut(run: Column) -> Column:
        def marked(chars: Column) -> Column:
            ends = lambda c, i: F.pmod(F.xxhash64(F.get(chars, i - 1), c), F.lit(_ENDS)) == 0
            return F.array_join(F.transform(chars, lambda c, i: F.when(ends(c, i), F.concat(c, F.lit(" "))).otherwise(c)), "")

        # the characters are split once and bound to a name
        spaced = F.get(F.transform(F.array(F.split(run, "")), marked), F.lit(0))
        return F.regexp_extract_all(spaced, F.lit(f"[^\\x20]{{1,{PIECE}}}"), F.lit(0))

    return F.flatten(F.transform(whole, lambda w: F.when(F.length(w) > PIECE, cut(w)).otherwise(F.array(w))))


def grams(pieces: Column) -> Column:
    """Sorted numbers (hash of two neighbouring pieces, place) of a text; one piece stands alone.
    Pieces behind the first 16.7 million share the last place: no order is kept among them."""
    heads = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1)))
    return F.sort_array(
        F.transform(
            heads,
            lambda p, i: F.shiftleft(_low(F.xxhash64(p, F.get(pieces, i + 1)), 39), _PLACE).bitwiseOR(
                F.least(i.cast("long"), F.lit((1 << _PLACE) - 1))
            ),
        )
    )


def numbered(sorted_grams: Column) -> Column:
    """Sorted numbers (bucket, hash of gram and occurrence, place): the n-th copy of a gram is a
    gram of its own. In sorted order copies stand together; how many stand before one is found
    by halving steps, exact up to 2**24 copies."""
    gram = lambda x: F.shiftright(x, _PLACE)
    here = lambda j, x: F.coalesce(gram(F.get(sorted_grams, j)) == gram(x), F.lit(False))

    def copies(x: Column, i: Column) -> Column:
        steps = F.array(*[F.lit(1 << b) for b in range(_PLACE - 1, -1, -1)])
        walk = F.aggregate(steps, F.lit(0), lambda n, s: F.when((i - n - s >= 0) & here(i - n - s, x), n + s).otherwise(n))
        return F.when((i > 0) & here(i - 1, x), walk).otherwise(F.lit(0))

    hash_bits = 63 - _PLACE
    return F.sort_array(
        F.transform(
            sorted_grams,
            lambda x, i: F.shiftleft(_low(F.xxhash64(gram(x), copies(x, i)), hash_bits), _PLACE).bitwiseOR(_low(x, _PLACE)),
        )
    )


def _bucket(x: Column) -> Column:
    return F.shiftright(x, 63 - _BUCKET)


def picked(numbers: Column) -> Column:
    """Of each bucket the two least grams, sorted by (bucket, place in the text)."""
    other = lambda j, x: F.coalesce(_bucket(F.get(numbers, j)) != _bucket(x), F.lit(True))
    least = F.filter(numbers, lambda x, i: (i < 2) | other(i - 2, x))
    return F.sort_array(
        F.transform(
            least,
            lambda x: F.shiftleft(_bucket(x), 63 - _BUCKET)
            .bitwiseOR(F.shiftleft(_low(x, _PLACE), _REST))
            .bitwiseOR(_low(F.shiftright(x, _PLACE), _REST)),
        )
    )


def tuples(ordered: Column) -> Column:
    """Each bucket's grams hashed in text order: the bucket (6 bits) and 25 bits of the hash.

    Buckets without grams are left out.
    """
    same = lambda j, x: F.coalesce(_bucket(F.get(ordered, j)) == _bucket(x), F.lit(False))
    first = lambda x, i: F.when((i > 0) & same(i - 1, x), _low(F.get(ordered, i - 1), _REST))
    number = lambda x, i: F.xxhash64(first(x, i), _low(x, _REST))
    hashed = F.transform(
        ordered,
        lambda x, i: F.when(
            ~same(i + 1, x), F.shiftleft(_bucket(x), 25).bitwiseOR(_low(number(x, i), 25)).cast("int")
        ),
    )
    return F.array_compact(hashed)


def with_signature(df: DataFrame, text_col: str, into: str) -> DataFrame:
    """``df`` with the signature (array of int) of a text column; null text counts as empty.

    Each step is a column of its own, as steps look at neighbours in the array before them; their
    names are none of ``df``'s.
    """
    taken = {c.lower() for c in (*df.columns, into)}
    free = (f"_step{i}" for i in range(len(taken) + 4) if f"_step{i}" not in taken)
    pieces, by_gram, by_number, least = (next(free) for _ in range(4))
    out = df.withColumn(pieces, pieces_of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    out = out.withColumn(by_gram, grams(F.col(pieces))).withColumn(by_number, numbered(F.col(by_gram)))
    out = out.withColumn(least, picked(F.col(by_number))).withColumn(into, tuples(F.col(least)))
    return out.drop(pieces, by_gram, by_number, least)


def as_text(sig: Column) -> Column:
    """The signature as lowercase hex, 8 digits a bucket."""
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of buckets whose pairs agree; two empty texts are alike, 0 to 1."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) over distinct ids: the next smaller one; after the least, the greatest.

    Ids are sorted by range; neighbours meet inside a range, and one row per range closes gaps.
    """
    spread = stored(
        ids.where("doc_id is not null").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()),
        "ids",
    )
    tops = spread.groupBy("part").agg(F.max("doc_id").alias("top"))
    whole = W.orderBy("part")
    tops = tops.select(
        F.col("part").alias("p"),
        F.coalesce(F.lag("top").over(whole), F.max("top").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before"),
    )
    inside = spread.withColumn("less", F.lag("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    # as many rows as the range exchange has partitions
    return inside.join(F.broadcast(tops), F.col("part") == F.col("p")).select(
        "doc_id", F.coalesce("less", "before").alias("next_id")
    )


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint next to those of its edited text and of the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of
    the next document in descending id. Null text counts as empty. Of rows with the same id the
    one with the least text serves as the next document; rows without an id have an empty next
    document. An empty table gives no rows; other columns are ignored. Texts are exchanged once,
    by id, for both joins; half a text and one signature travel to the document before.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # both joins filter and select alike, without needless aliases, and signatures follow them, so
    # that Spark finds the two exchanges of the texts equal and makes one
    plain = id_col == "doc_id" and docs.schema[id_col].dataType.typeName() == "long"
    ident = F.col("doc_id") if plain else F.col(f"`{id_col}`").cast("long").alias("doc_id")
    base = docs.select(ident, text.alias("text"))
    known, unknown = base.where("doc_id is not null"), base.where("doc_id is null")
    wanted = next_ids(base.select("doc_id")).withColumnsRenamed({"doc_id": "asker", "next_id": "asked"})
    sizes = docs.select(F.col(f"`{id_col}`").cast("long").alias("asker"), F.floor(F.length(text) / 2).alias("want"))
    sizes = sizes.groupBy("asker").agg(F.max("want").alias("want"))
    wanted = stored(wanted.join(sizes, "asker"), "asked")
    asked = with_signature(known.join(wanted, known.doc_id == wanted.asked), "text", "next_sig")
    given = asked.select("asker", F.expr("substring(text, 1, cast(want as int))").alias("head"), "next_sig")
    given = given.groupBy("asker").agg(F.min(F.struct("head", "next_sig")).alias("given"))
    both = known.join(given, known.doc_id == given.asker, "left").select(*known.columns, "given")
    both = with_signature(both.unionByName(unknown, allowMissingColumns=True), "text", "sig").select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "sig",
        F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 2) as int)), "
               "coalesce(substring(given.head, 1, cast(floor(length(text) / 2) as int)), ''))").alias("edited"),
        F.coalesce("given.next_sig", F.array().cast("array<int>")).alias("next_sig"),
    )
    out = with_signature(both, "edited", "edited_sig")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
