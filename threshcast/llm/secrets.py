"""Secrets found by patterns and by character Markov models, from built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
#: Tokens of at least so many characters are judged by the models.
LEAST = 16
#: Log-likelihood ratio from which a token counts as random, in nats.
THRESHOLD = 12.0
#: Documents (as expected by a hash of their text) that the models are trained on at most.
TRAIN_DOCS = 4000
_SPAN = "struct<start:bigint,rank:int,finish:bigint>"


def found(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern and the pieces between them (one more than matches)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def located(matches: Column, gaps: Column, rank: int, good) -> Column:
    """Spans (code points, end exclusive) of the matches that ``good`` accepts, in order."""
    step = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["g"])
        finish = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), finish.alias("finish")))
        return F.struct(finish.alias("at"), F.when(good(x["m"]), F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(step, begin, add, lambda s: s["out"])


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_base``: the spans of the three base kinds, by start, then kind."""
    out, text = docs, F.col(text_col)
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        rank = KINDS.index(name)
        good = lambda m: F.lit(True)
        if name == "assign":
            # alone, a match is matched again as it was in the text
            good = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
        matches, gaps = found(text, pattern)
        spans = F.when(text.rlike(pattern), located(matches, gaps, rank, good))
        out = out.withColumn(f"_{name}", F.coalesce(spans, F.array().cast(f"array<{_SPAN}>")))
    joined = F.sort_array(F.concat("_assign", "_access", "_hex"))
    return out.withColumn("_base", joined).drop("_assign", "_access", "_hex")


def pairs_of(token: Column) -> Column:
    """Numbers of the neighbouring characters of a token: 67 * first + second, from the start."""
    width = len(ALPHABET)
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    places = F.sequence(F.lit(1), F.length(token) - 1)
    at = lambda i: code(F.substring(token, i, F.lit(1)))
    return F.when(F.length(token) > 1, F.transform(places, lambda i: at(i) * width + at(i + 1))).otherwise(
        F.array().cast("array<int>")
    )


def train(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> list[float]:
    """Log-likelihood ratios of the 67 * 67 pairs of characters, random against ordinary.

    Labelled samples: values of base matches are random strings, the other tokens of the same
    documents are ordinary identifiers. About ``train_docs`` documents are used, drawn by hash;
    smaller tables are used whole. Counts come from one grouped aggregation with one row per pair
    and class. Rare first characters lean on how frequent the second is in the class, and a tenth
    of each model is uniform, so no single pair decides.
    """
    width = len(ALPHABET)
    text = F.col(f"`{text_col}`")
    rows = docs.where(text.isNotNull()).select(text.alias("_text"))
    total = rows.count()
    if total > train_docs:
        share = int(train_docs / total * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("_text", F.lit("train")), F.lit(1 << 30)) < share)
    values = F.concat(
        F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)),
        F.regexp_extract_all("_text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("_text", F.lit(HEX), F.lit(0)),
    )
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(rest, F.lit(TOKEN + "{4,}"), F.lit(0))
    random = rows.select(F.lit(1).alias("random"), F.explode(values).alias("token")).where(F.length("token") >= ASSIGN_LEAST)
    random = random.withColumn("token", F.regexp_replace("token", f"[^{TOKEN[1:-1]}]", "-"))
    ordinary = rows.select(F.lit(0).alias("random"), F.explode(words).alias("token"))
    counts = (
        random.union(ordinary)
        .select("random", F.explode(pairs_of(F.col("token"))).alias("pair"))
        .groupBy("random", "pair").agg(F.count("*").alias("n"))
        .collect()
    )
    seen = [[0.0] * (width * width) for _ in range(2)]
    for r in counts:
        seen[r.random][r.pair] = float(r.n)
    logs = []
    for table in seen:
        out, all_seen = [], sum(table) + width / 2
        second = [(sum(table[b::width]) + 0.5) / all_seen for b in range(width)]
        for a in range(width):
            row = table[a * width : (a + 1) * width]
            whole = sum(row)
            out += [math.log(0.9 * (n + 8 * p) / (whole + 8) + 0.1 / width) for n, p in zip(row, second)]
        logs.append(out)
    return [a - b for a, b in zip(logs[1], logs[0])]


def scored(token: Column, model: Column) -> Column:
    return F.aggregate(pairs_of(token), F.lit(0.0), lambda s, p: s + F.coalesce(F.get(model, p), F.lit(0.0)))


def find(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, rank, finish), by start, then kind.

    ``rank`` is the place in ``KINDS``. Tokens of ``LEAST`` characters or more that touch no base
    span and whose ratio reaches ``THRESHOLD`` are added to the base spans, which all stay.
    Null text counts as empty.
    """
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    out = base_spans(docs.withColumn("_text", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), "_text")
    pattern = f"{TOKEN}{{{LEAST},}}"
    matches, gaps = found(F.col("_text"), pattern)
    out = out.withColumn("_long", matches)
    hits = F.exists("_long", lambda m: scored(m, ratios) >= THRESHOLD)
    spans = F.when(hits, located(F.col("_long"), gaps, KINDS.index("random"), lambda m: scored(m, ratios) >= THRESHOLD))
    out = out.withColumn("_added", F.coalesce(spans, F.array().cast(f"array<{_SPAN}>")))
    free = F.filter(
        "_added", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["finish"]) & (s["start"] < b["finish"]))
    )
    out = out.withColumn("secret_spans", F.sort_array(F.concat("_base", free)))
    return out.drop("_text", "_long", "_added", "_base")


def named(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    say = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["finish"].cast("string"))
    return F.array_join(F.transform(spans, say), ",")


def report(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row.

    Null text has no spans; repeated rows are reported each; a null id stays null; an empty table
    gives no rows. Only the two columns named are read, so others may have any name.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = find(rows, model)
    spans = F.col("secret_spans")
    number = lambda k: F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda s: s["rank"] < 3)
    return out.select("doc_id", *[number(k) for k in KINDS], F.sha2(named(base), 256).alias("base_sha256"), named(spans).alias("spans"))


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "<SECRET>",
           length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``, columns as they were.

    Overlapping spans are replaced together; the length column follows. Texts without secrets,
    nulls included, stay as they are.
    """
    columns = docs.columns
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    text = f"c{columns.index(text_col)}"
    out = find(held, model, text)
    piece = lambda start, n: F.substring(F.col(text), start.cast("int"), n.cast("int"))

    def add(state: Column, s: Column) -> Column:
        longer = F.greatest(state["at"], s["finish"])
        grown = F.concat(state["out"], piece(state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(longer.alias("at"), F.when(s["start"] < state["at"], state["out"]).otherwise(grown).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("secret_spans", begin, add, lambda s: F.concat(s["out"], piece(s["at"] + 1, F.length(text) - s["at"])))
    changed = F.size("secret_spans") > 0
    out = out.withColumn("_clean", F.when(changed, clean))
    result = []
    for i, c in enumerate(columns):
        column = F.col(f"c{i}")
        if c == text_col:
            column = F.when(changed, F.col("_clean")).otherwise(column)
        elif c == length_col:
            column = F.when(changed, F.length("_clean").cast(docs.schema[c].dataType)).otherwise(column)
        result.append(column.alias(c))
    return out.select(*result)
