"""Bulk candidate match (J5): for every unmapped internal row, the first ``k``
remote records (by id) whose name contains the row's term, case-insensitively
-- the search the mapping dialog runs one row at a time, done for all rows.

A plain theta join (``name ILIKE '%' || term || '%'``) is a nested loop,
O(terms x records).  The exact replacement used here:

1. Terms are deduplicated per (group, lower(term)): the answer depends only on
   the text, so each distinct text is matched once and joined back.
2. Each term is blocked on its rarest literal trigram (a gram with no '%'/'_'),
   or, when it has none, its rarest literal bigram or character.  A name that
   contains the term contains every literal gram of it, so no candidate is
   lost.  Records give only grams of the lengths that terms of their group are
   blocked on; gram frequencies come from a partial aggregation.  Records and
   terms are spread over the tasks first, as a few files may hold many.
3. The equi join on (group, gram) is salted by gram size (known from step 2):
   a gram held by a third of all records is spread over many tasks, a rare
   gram stays in one.
4. Candidates are verified with the real predicate and cut to ``k`` per term
   with a row_number filter, which Spark applies map-side too
   (WindowGroupLimit), so a hot term never ships more than k rows per task.

Terms made only of wildcards ('%%', '__') have no literal gram; they match
every name at least as long as their '_' count, so they are joined to records
on (group, length >= threshold): one threshold per distinct '_' count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators.search import term_ok_col

_LIT = "g NOT RLIKE '[%_]'"
#: Lengths of the grams that a term may be blocked on, the one to take first (longer: held by fewer records).
SIZES = (3, 2, 1)


def _grams(s: str, n: int, where: str | None = None) -> Column:
    every = f"transform(sequence(1, char_length({s}) - {n - 1}), i -> substring({s}, i, {n}))"
    return F.expr(f"CASE WHEN char_length({s}) >= {n} THEN {f'filter({every}, g -> {where})' if where else every} ELSE array() END")


def _spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as shuffles have, however few files they are in: each becomes many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _holding(recs: DataFrame, texts: DataFrame, g: list[str]) -> DataFrame:
    """(group, _id, _name, _gram): the grams of the records of the sizes that some text of the group is blocked on.

    Nothing is left out here for holding '%' or '_': no text has such a gram.
    """
    out = None
    for n in SIZES:
        used = texts.where(F.col("_size") == n)
        some = recs.join(used.select(*g).distinct(), g, "left_semi") if g else recs.join(F.broadcast(used.limit(1).select("_size")), how="cross").drop("_size")
        part = some.select(*g, "_id", "_name", F.explode(F.array_distinct(_grams("_ln", n))).alias("_gram"))
        out = part if out is None else out.unionByName(part)
    return out


def _pattern(term: Column) -> Column:
    return F.concat(F.lit("%"), F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def _term_key(term: Column, trim: bool) -> Column:
    return F.lower(F.trim(term) if trim else term)


def match_candidates(terms: DataFrame, records: DataFrame, *, term_col: str = "term", record_id: str = "Id",
                     record_field: str = "Name", group_cols: list[str] | None = None, k: int = S.SEARCH_LIMIT,
                     min_length: int = 2, rows_per_salt: int = 50000,
                     trim: bool = True) -> DataFrame:
    """Returns every column of ``terms`` plus candidate_id, candidate_name and
    rank (1..k, by candidate id).  Terms are trimmed (the dialog sends the
    trimmed text) and shorter than ``min_length`` get no candidates.

    Each blocking gram is split into ceil(records holding it / rows_per_salt)
    salts: a cold gram stays one task, a gram held by a third of all records is
    spread over as many as its size asks for."""
    g = list(group_cols or [])
    t_ok = terms.where(term_ok_col(F.col(term_col), min_length))
    texts = t_ok.select(*g, _term_key(F.col(term_col), trim).alias("_lt")).distinct()
    texts = texts.select(*g, "_lt", F.col("_lt").rlike("[%_]").alias("_wild"), *[_grams("_lt", n, _LIT).alias(f"_{n}") for n in SIZES])
    size = F.coalesce(*[F.when(F.size(f"_{n}") > 0, F.lit(n)) for n in SIZES], F.lit(0))
    texts = texts.select(*g, "_lt", "_wild", size.alias("_size"),
                         F.coalesce(*[F.when(F.size(f"_{n}") > 0, F.col(f"_{n}")) for n in SIZES], F.col(f"_{SIZES[-1]}")).alias("_grams"))

    recs = records.select(*g, F.col(record_id).alias("_id"), F.col(record_field).alias("_name"))
    recs = _spread(recs.where(F.col("_name").isNotNull())).withColumn("_ln", F.lower("_name"))

    # Term grams and their frequency among records (only grams terms use).
    term_grams = texts.select(*g, "_lt", F.explode(F.array_distinct("_grams")).alias("_gram"))
    wanted = term_grams.select(*g, "_gram").distinct()
    rec_grams = _holding(recs, texts, g)
    # Counted before the join: a task ships each gram once, not each record once for every gram.
    freq = rec_grams.groupBy(*g, "_gram").agg(F.count(F.lit(1)).alias("_n")).join(wanted, [*g, "_gram"], "left_semi")
    chosen = (term_grams.join(freq, [*g, "_gram"], "left")
              .withColumn("_n", F.coalesce("_n", F.lit(0)))
              .groupBy(*g, "_lt").agg(F.min(F.struct("_n", "_gram")).alias("_best"))
              .select(*g, "_lt", F.col("_best._gram").alias("_gram"), F.col("_best._n").alias("_n")))
    chosen = (chosen.join(texts.select(*g, "_lt", "_wild"), [*g, "_lt"])
              .withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows_per_salt))).cast("int")))

    # Equi join on (group, gram, salt); the salt count follows the gram's size.
    probe = chosen.select(*g, "_lt", "_wild", "_gram",
                          F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    used = chosen.select(*g, "_gram", "_salts").distinct()
    build = (rec_grams.join(used, [*g, "_gram"])
             .withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")).drop("_salts"))
    cand = probe.join(build, [*g, "_gram", "_salt"])
    cand = cand.withColumn("_pat", _pattern(F.col("_lt"))).withColumn("_lname", F.lower("_name"))
    cand = cand.where(F.when(F.col("_wild"), F.expr("_lname LIKE _pat"))
                      .otherwise(F.col("_lname").contains(F.col("_lt"))))
    hits = cand.select(*g, "_lt", "_id", "_name")

    # Wildcard-only terms.
    wild_only = texts.where(F.size("_grams") == 0).select(
        *g, "_lt", (F.char_length("_lt") - F.char_length(F.regexp_replace("_lt", "_", ""))).alias("_min_len"))
    thresholds = wild_only.select(*g, "_min_len").distinct()
    if g:
        # Per group the thresholds grow with the groups: a plain equi join on
        # the group (AQE decides), the length test as its condition.
        cond = [recs[c] == thresholds[c] for c in g] + [F.char_length(recs["_name"]) >= thresholds["_min_len"]]
        w_hits = recs.join(thresholds, cond)
    else:
        # One threshold per distinct '_' count: bounded by the longest term.
        w_hits = recs.join(F.broadcast(thresholds), F.char_length(recs["_name"]) >= thresholds["_min_len"])
    w_hits = w_hits.select(*[recs[c] for c in g], "_min_len", "_id", "_name")
    w_hits = w_hits.join(wild_only, [*g, "_min_len"]).select(*g, "_lt", "_id", "_name")

    allhits = hits.unionByName(w_hits)
    w = Window.partitionBy(*g, "_lt").orderBy("_id")
    top = allhits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    keyed_terms = _spread(t_ok).withColumn("_lt", _term_key(F.col(term_col), trim))
    out = keyed_terms.join(top, [*g, "_lt"])
    return out.select(*terms.columns, F.col("_id").alias("candidate_id"), F.col("_name").alias("candidate_name"),
                      F.col("rank").cast("long").alias("rank"))


def match_candidates_nested(terms: DataFrame, records: DataFrame, *, term_col: str = "term", record_id: str = "Id",
                            record_field: str = "Name", group_cols: list[str] | None = None,
                            k: int = S.SEARCH_LIMIT, min_length: int = 2, trim: bool = True) -> DataFrame:
    """The plain theta-join form (reference for tests and the benchmark)."""
    g = list(group_cols or [])
    t = (terms.where(term_ok_col(F.col(term_col), min_length))
         .withColumn("_pat", _pattern(F.trim(F.col(term_col)) if trim else F.col(term_col))))
    r = records.select(*g, F.col(record_id).alias("candidate_id"), F.col(record_field).alias("candidate_name"))
    cond = [t[c] == r[c] for c in g] + [F.expr("candidate_name ILIKE _pat")]
    j = t.join(r, cond).select(*[t[c] for c in terms.columns], "candidate_id", "candidate_name")
    w = Window.partitionBy(*[F.col(c) for c in terms.columns]).orderBy("candidate_id")
    return (j.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k))


# Search route per internal type, as the mapping dialog chooses it.
ROUTES = {"Customer": "DisplayName", "Vendor": "DisplayName", "MenuItem": "Name"}


def match_routed(internal: DataFrame, sources: dict, *, type_col: str = "type", **kw) -> tuple[DataFrame, DataFrame]:
    """J5 for internal rows of several types: Customer and Vendor rows search
    their remote records by DisplayName, MenuItem rows by Name (``sources``
    maps type -> records frame).  Rows of any other type are returned as
    errors 'Invalid entity type provided: <type>'.  Returns (candidates,
    errors)."""
    out = None
    for typ, field in ROUTES.items():
        if typ not in sources:
            continue
        part = match_candidates(internal.where(F.col(type_col) == typ), sources[typ], record_field=field, **kw)
        out = part if out is None else out.unionByName(part)
    errors = internal.where(~F.col(type_col).isin(list(ROUTES)) | F.col(type_col).isNull()).withColumn(
        "error", F.concat(F.lit("Invalid entity type provided: "), F.coalesce(F.col(type_col), F.lit(""))))
    return out, errors
