"""Ground-truth questions from a table of claims, and how answers to them are judged.

``rows``: ``row`` (from 1), ``policy``, ``claim``, ``fraud`` (boolean), ``amount`` (double), ``word``.
All builders return ``category, query, expected array<string>, mode, seq``; ``seq`` is the order in
which questions are taken when a workload is cut to its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate

SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)
LEAST_REPEATS = 3
MOST_WORDS = 15


def _made(df: DataFrame, category: str, query: Column, expected: Column, mode: str, seq: Column, *more) -> DataFrame:
    return df.select(F.lit(category).alias("category"), query.alias("query"), expected.alias("expected"), F.lit(mode).alias("mode"), seq.cast("long").alias("seq"), *more)


def id_lookups(rows: DataFrame, n: int) -> DataFrame:
    """One question for each of ``n`` places spread evenly over the table, both ends among them."""
    total = rows.agg(F.max("row").alias("n")).first()["n"] or 0
    at = rows.sparkSession.createDataFrame([(p,) for p in evaluate.positions(total, n)], "row long")
    picked = rows.join(F.broadcast(at), "row", "left_semi")
    return _made(picked, "id-lookup", F.concat(F.lit("What is the status of claim "), "claim", F.lit("?")), F.array("claim"), "exact", F.col("row"))


def fraud_lists(rows: DataFrame, n: int) -> DataFrame:
    """The fraudulent claims of each of the first ``n`` policies that have any, in file order."""
    per = rows.filter("fraud").groupBy("policy").agg(F.sort_array(F.collect_set("claim")).alias("claims"), F.min("row").alias("first"))
    first = per.orderBy("first", "policy").limit(n)
    return _made(first, "fraud-list", F.concat(F.lit("Show me all fraud claims under policy "), "policy"), F.col("claims"), "exact", F.col("first"))


def cuts(rows: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame | None:
    """``i, share, t``: values half-way between two distinct amounts, for each share of them; None for fewer than two.

    Places among the distinct amounts come from running counts per range of values, so that no task
    sorts them all.
    """
    values = rows.filter("amount is not null").select("amount").distinct()
    bounds = values.agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not bounds["n"] or bounds["n"] < 2:
        return None
    cells = 1024
    width = (bounds["hi"] - bounds["lo"]) / cells
    binned = values.withColumn("bin", F.least(F.floor((F.col("amount") - bounds["lo"]) / width), F.lit(cells - 1)).cast("int"))
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("here"))
    before = sizes.withColumn("before", F.sum("here").over(Window.orderBy("bin")) - F.col("here")).select("bin", "before")
    ranked = binned.join(F.broadcast(before), "bin").withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("amount")))
    wanted = [(i, s, max(1, min(int(bounds["n"] * s) + 1, bounds["n"] - 1))) for i, s in enumerate(shares)]
    asked = rows.sparkSession.createDataFrame(wanted, "i int, share double, at long")
    pair = ranked.join(F.broadcast(asked), (F.col("rn") == F.col("at")) | (F.col("rn") == F.col("at") + 1))
    return pair.groupBy("i", "share").agg(((F.min("amount") + F.max("amount")) / 2).alias("t"))


def _over(t: Column) -> Column:
    return F.concat(F.lit("Show me all claims with Amount over "), F.regexp_replace(F.format_string("%.4f", t), r"\.?0+$", ""))


def thresholds(rows: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Claims above each of the ``cuts``.  ``expected`` holds what lies above: the answer itself."""
    cut = cuts(rows, shares)
    if cut is None:
        return _made(rows.limit(0), "amount-threshold", F.lit(""), F.array("claim"), "top-k", F.col("row"))
    # a handful of cuts: every row meets them in one pass
    over = rows.join(F.broadcast(cut), F.col("amount") > F.col("t")).groupBy("i", "t").agg(F.sort_array(F.collect_set("claim")).alias("claims"))
    return _made(over, "amount-threshold", _over(F.col("t")), F.col("claims"), "top-k", F.col("i"))


def frequent_words(rows: DataFrame, most: int = MOST_WORDS, least: int = LEAST_REPEATS) -> DataFrame:
    """``term, n``: the values that occur most often, ``least`` times or more."""
    term = F.lower(F.trim("word"))
    counts = rows.filter(term != "").groupBy(term.alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most)


def keywords(rows: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    terms = frequent_words(rows, most)
    met = rows.withColumn("term", F.lower(F.trim("word"))).join(F.broadcast(terms), "term").groupBy("term", "n").agg(F.sort_array(F.collect_set("claim")).alias("claims"))
    return _made(met, "keyword", F.concat(F.lit("Show me all claims with cause "), "term"), F.col("claims"), "top-k", -F.col("n"))


def build(rows: DataFrame, target: int) -> DataFrame:
    """``qid`` and the builders' columns: about ``target`` questions, each asked once.

    A quarter may be fraud lists; the rest is look-ups, thresholds and keywords, in that order.
    """
    every = [id_lookups(rows, max(1, target // 2)), fraud_lists(rows, target // 4), thresholds(rows), keywords(rows)]
    return _cut_to(every, target).select("qid", "category", "query", "expected", "mode")


def build_unlisted(rows: DataFrame, target: int) -> DataFrame:
    """``build`` without the lists of thresholds and keywords, which are as long as the table: plus ``over`` and ``term``.

    Their ``expected`` is empty; ``over`` or ``term`` says which claims it stands for (see ``listed``).
    """
    none, nothing = F.array().cast("array<string>"), F.lit(None)
    plain = [p.withColumn("over", nothing.cast("double")).withColumn("term", nothing.cast("string")) for p in (id_lookups(rows, max(1, target // 2)), fraud_lists(rows, target // 4))]
    cut, terms = cuts(rows), frequent_words(rows)
    if cut is not None:
        cut = _made(cut.withColumn("over", F.col("t")), "amount-threshold", _over(F.col("t")), none, "top-k", F.col("i"), "over", nothing.cast("string").alias("term"))
        plain.append(cut)
    plain.append(_made(terms, "keyword", F.concat(F.lit("Show me all claims with cause "), "term"), none, "top-k", -F.col("n"), nothing.cast("double").alias("over"), "term"))
    return _cut_to(plain, target).select("qid", "category", "query", "expected", "mode", "over", "term")


def listed(asked: DataFrame, rows: DataFrame, results: DataFrame) -> DataFrame:
    """``build_unlisted``'s questions with ``expected``: of a threshold or keyword those of its claims that the results name.

    That is what ``evaluate.hits`` asks of a top-k list; claims that no result names are left out, so that of ``judge``'s columns
    ``expected_total`` and what is missing do not count them.  ``results``: as in ``judge``; their ids meet the rows, no list is made of the rows.
    """
    none = F.array().cast("array<string>")
    ids = F.array_union(F.array_union(*[F.coalesce(c, none) for c in ("retrieved", "kept")]), F.coalesce("seeds", none))
    wide = asked.filter("over is not null or term is not null").select("qid", "over", "term")
    named = results.select("qid", F.explode(ids).alias("claim")).join(wide, "qid")
    amounts = rows.select("claim", "amount", F.lower(F.trim("word")).alias("word"))
    met = named.join(amounts, "claim").filter((F.col("amount") > F.col("over")) | (F.col("word") == F.col("term")))
    held = met.groupBy("qid").agg(F.sort_array(F.collect_set("claim")).alias("held"))
    return asked.join(held, "qid", "left").select("qid", "category", "query", F.coalesce("held", "expected").alias("expected"), "mode")


def _cut_to(parts: list[DataFrame], target: int) -> DataFrame:
    """The first ``target`` of the builders' questions in their order, each asked once, with ``qid``."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        every = p if every is None else every.union(p)
    rest = [c for c in every.columns if c not in ("category", "query")]
    once = every.groupBy("category", "query").agg(F.min_by(F.struct(*rest), F.struct("part", "seq")).alias("r"))
    once = once.select("category", "query", "r.*").orderBy("part", "seq", "query").limit(target)
    return once.withColumn("qid", F.row_number().over(Window.orderBy("part", "seq", "query")))


MOST_MATCHES, MOST_EXPECTED = 500, 3000
ANY_ID = r"\b(?:CLM|POL|PH|COV|FRD)-\d{3,}\b"


def probes(rows: DataFrame, absent: int, n: int = 15, share: float = 0.5) -> DataFrame:
    """``qid, kind, variant, query, expected, mode``: questions beyond those that a system was tuned on.

    Paraphrases ask for claims without naming them: by the policies of ``n`` rows spread over the table, and by the
    most frequent word that at most ``MOST_MATCHES`` claims share.  Negatives name ids with the number ``absent``,
    which no record may have, or unknown things; they must come back empty (``refuse``).  The others use words of
    other layouts: a fraudulent claim, an occupation that no record has, dollars above the ``share`` of amounts
    (left out above ``MOST_EXPECTED`` claims).  A table without rows gives the negatives and the occupation.
    """
    spark = rows.sparkSession
    total = rows.agg(F.max("row").alias("n")).first()["n"] or 0
    at = spark.createDataFrame([(p,) for p in evaluate.positions(total, n)], "row long")
    policies = rows.join(F.broadcast(at), "row", "left_semi").select("policy").distinct()
    own = rows.join(policies, "policy", "left_semi").groupBy("policy").agg(F.sort_array(F.collect_set("claim")).alias("claims"))
    term = F.lower(F.trim("word"))
    counts = rows.filter(term != "").groupBy(term.alias("term")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n").between(LEAST_REPEATS, MOST_MATCHES)).orderBy(F.desc("n"), "term").limit(1)
    same = rows.withColumn("term", term).join(F.broadcast(top), "term").groupBy("term").agg(F.sort_array(F.collect_set("claim")).alias("claims"))
    first = rows.groupBy().agg(F.min_by("claim", F.struct("row", "claim")).alias("claim")).filter("claim is not null")
    over = thresholds(rows, (share,)).filter(F.size("expected") <= MOST_EXPECTED)
    none = F.array().cast("array<string>")
    number = f"{absent:05d}"
    empty = [
        ("negative", "nonexistent-id", f"How does claim CLM-{number} stand?"),
        ("negative", "unknown-words", "List claims that a zeppelin wormhole brought about"),
        ("negative", "nonexistent-policy", f"List every claim that belongs to policy POL-{number}"),
        ("negative", "nonexistent-fraud-id", f"Has claim CLM-{number} turned out to be a fraud?"),
        ("cross-schema", "occupation-words", "List claims that dentists have made"),
    ]
    one = lambda df, kind, variant, query, expected, mode: df.select(F.lit(kind).alias("kind"), F.lit(variant).alias("variant"), query.alias("query"), expected.alias("expected"), F.lit(mode).alias("mode"))
    every = one(own, "paraphrase", "policy", F.concat(F.lit("List every claim that belongs to policy "), "policy"), F.col("claims"), "exact")
    every = every.union(one(same, "paraphrase", "word", F.concat(F.lit("List all claims to do with "), "term"), F.col("claims"), "top-k"))
    every = every.union(spark.createDataFrame(empty, "kind string, variant string, query string").select("*", none.alias("expected"), F.lit("refuse").alias("mode")))
    every = every.union(one(first, "cross-schema", "fraud-words", F.concat(F.lit("Did claim "), "claim", F.lit(" prove fraudulent?")), F.array("claim"), "exact"))
    dollars = F.concat(F.lit("Which claims come to more than $"), F.regexp_extract("query", r"over ([0-9.]+)$", 1), F.lit("?"))
    every = every.union(one(over, "cross-schema", "dollar-words", dollars, F.col("expected"), "top-k"))
    # a probe set is small: a few dozen questions
    return every.withColumn("qid", F.row_number().over(Window.orderBy("kind", "variant", "query"))).select("qid", "kind", "variant", "query", "expected", "mode")


def judge_probes(asked: DataFrame, results: DataFrame) -> DataFrame:
    """``qid, kind, variant, query, mode, retrieval_hit, prune_hit, answer_ok, bad_seeds, fabricated``.

    ``results``: ``qid, answer, retrieved, kept, seeds``.  A claim or policy that is a seed must be expected or named by
    the question.  An answer must name an expected node or one that the question names; a refusal names none,
    and nothing may be found for it.  A probe without a result counts as one that found nothing.
    """
    none = F.array().cast("array<string>")
    j = asked.join(results, "qid", "left").withColumns({c: F.coalesce(c, none) for c in ("retrieved", "kept", "seeds")})
    ids = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ANY_ID), F.lit(0)))
    allowed = F.array_union("expected", ids("query"))
    refuse, exact = F.col("mode") == "refuse", F.col("mode") == "exact"
    bad = F.array_except(F.filter("seeds", lambda s: s.startswith("CLM") | s.startswith("POL")), allowed)
    clean = F.size("bad") == 0
    all_in = lambda c: F.size(F.array_except("expected", c)) == 0
    empty = (F.size("seeds") == 0) & (F.size("retrieved") == 0)
    j = j.withColumns({"bad": F.when(refuse, none).otherwise(bad), "named": ids("answer")})
    retrieval = F.when(refuse, empty).when(exact, all_in("retrieved") & clean).otherwise(F.arrays_overlap("expected", "retrieved") & clean)
    pruning = F.when(refuse, empty).when(exact, all_in("kept")).otherwise(F.arrays_overlap("expected", "kept") & clean)
    said = F.when(refuse, F.size("named") == 0).otherwise((F.size("expected") > 0) & F.arrays_overlap("named", allowed))
    few = lambda c: F.slice(F.array_sort(c), 1, 5)
    return j.select("qid", "kind", "variant", "query", "mode", retrieval.alias("retrieval_hit"), pruning.alias("prune_hit"), said.alias("answer_ok"), few(F.col("bad")).alias("bad_seeds"), few(F.when(refuse, F.col("named")).otherwise(none)).alias("fabricated"))


def probes_by_kind(judged: DataFrame) -> DataFrame:
    """``kind, passed, total, answered, accuracy``: probes that retrieval and pruning both passed, and right answers."""
    ok = F.count_if(F.col("retrieval_hit") & F.col("prune_hit"))
    n = F.count(F.lit(1))
    return judged.groupBy("kind").agg(ok.alias("passed"), n.alias("total"), F.count_if("answer_ok").alias("answered"), F.round(100 * ok / n, 2).alias("accuracy"))


def judge(workload: DataFrame, results: DataFrame) -> DataFrame:
    """Both hits of each question: in what was retrieved, and in what pruning kept.

    ``results``: ``qid, retrieved, kept, seeds`` (arrays), ``tokens_before, tokens_after,
    savings_percent``.  At most five missing ids are listed.
    """
    none = F.array().cast("array<string>")
    j = workload.join(results, "qid", "left")
    j = j.withColumns({c: F.coalesce(c, none) for c in ("retrieved", "kept", "seeds")})
    met = evaluate.hits(j.withColumn("got", F.col("retrieved"))).drop("got").withColumnsRenamed({"missing": "missing_from_graph", "hit": "retrieval_hit"})
    both = evaluate.hits(met.withColumn("got", F.col("kept"))).drop("got").withColumnsRenamed({"missing": "missing_after_prune", "hit": "prune_hit"})
    few = lambda c: F.slice(F.array_sort(c), 1, 5)
    return both.select("qid", "category", "query", "mode", F.size(F.array_intersect("expected", "retrieved")).alias("expected_found"), F.size("expected").alias("expected_total"), few("missing_from_graph").alias("missing_from_graph"), few("missing_after_prune").alias("missing_after_prune"), "retrieval_hit", "prune_hit", "tokens_before", "tokens_after", "savings_percent")


# For each edge type, which end is the document that states it, and the label of the
# other end where that document describes it as well; a policy is only referred to by its claims.
STATED = {
    "HAS_POLICY": ("dst", "Policyholder"),
    "COVERS": ("src", "Coverage"),
    "ENDORSED_BY": ("src", "Endorsement"),
    "HAS_CLAIM": ("dst", None),
    "FRAUD_DETECTED": ("src", "FraudFlag"),
    "INVESTIGATES_CLAIM": ("dst", "Investigator"),
}
DOCUMENTS = ["Policy", "Claim", "Endorsement"]


def document_truth(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (``doc, label, id``) and relations (``doc, src, type, dst``) that each document must yield.

    A policy, claim or endorsement is a document under its own id; an endorsement's has no relation.
    """
    rows = document_rows(nodes, edges)
    entities = rows.filter("kind = 'entity'").select("doc", F.col("what").alias("label"), F.col("a").alias("id"))
    return entities, rows.filter("kind = 'relation'").select("doc", F.col("a").alias("src"), F.col("what").alias("type"), F.col("b").alias("dst"))


def document_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both of ``document_truth`` in one: ``doc, kind, what, a, b``, an entity's id twice.

    Edges are told apart once, by their own columns; a relation and the entity that it describes come from the same row.  Types
    describe different labels, so that only an endorsement can be a document of its own and described too.
    """
    e = edges.filter(F.col("type").isin([*STATED])).select("src", "type", "dst").distinct()
    owned = F.col("type").isin([k for k, (end, _) in STATED.items() if end == "src"])
    owner, other = F.when(owned, F.col("src")).otherwise(F.col("dst")), F.when(owned, F.col("dst")).otherwise(F.col("src"))
    label = F.element_at(F.create_map(*[F.lit(x) for k, (_, lab) in STATED.items() if lab for x in (k, lab)]), F.col("type"))
    row = lambda kind, what, a, b: F.struct(F.lit(kind).alias("kind"), what.alias("what"), a.alias("a"), b.alias("b"))
    both = F.array_compact(F.array(row("relation", F.col("type"), F.col("src"), F.col("dst")), F.when(label.isNotNull(), row("entity", label, other, other))))
    # an edge from a document to itself describes it, which its own row says already
    twice = (F.col("r.kind") == "entity") & F.col("r.what").isin(DOCUMENTS)
    stated = e.select(owner.alias("doc"), F.explode(both).alias("r"))
    own = nodes.filter(F.col("label").isin(DOCUMENTS)).select("label", F.col("id"))
    own = own.select(F.col("id").alias("doc"), F.lit("entity").alias("kind"), F.col("label").alias("what"), F.col("id").alias("a"))
    again = edges.filter(F.col("type").isin([k for k, (_, lab) in STATED.items() if lab in DOCUMENTS])).select(owner.alias("doc"), F.lit("entity"), label, other)
    own = own.union(again).distinct().select("*", F.col("a").alias("b"))
    return stated.filter(~twice).select("doc", "r.*").union(own)


def edge_suite(results: DataFrame) -> DataFrame:
    """One row: questions that were retrieved, survived pruning and were answered; accuracy, savings, latency.

    ``results``: ``retrieved, survived_prune, answer_ok`` (boolean), ``savings_percent, latency_ms``.  Without
    questions all figures are 0.
    """
    n, ok = F.count(F.lit(1)), F.count_if(F.col("retrieved") & F.col("survived_prune") & F.col("answer_ok"))
    mean = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0))
    return results.agg(n.alias("total_queries"), ok.alias("passed"), F.when(n > 0, F.round(ok / n * 100, 1)).otherwise(0.0).alias("retrieval_accuracy"), mean("savings_percent").alias("avg_savings_pct"), mean("latency_ms").alias("avg_latency_ms"))
