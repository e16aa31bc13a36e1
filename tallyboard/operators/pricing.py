"""Pricing: exact book join, grade-ladder fallback, context rollups, hunted keys and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import half_up, has, slug
from tallyboard.operators import identity as I
from tallyboard.sources import scratch

#: Most rungs of a grading scale.
MOST_RUNGS = 1_000
BOOK = ("med", "lo", "hi", "n", "n12", "last_sale", "trend", "conf")


def last_row_wins(book: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per key: of duplicates the last one."""
    return book.groupBy("k").agg(F.max_by(F.struct(*[c for c in book.columns if c != "k"]), ordinal).alias("_r")).select("k", "_r.*")


def with_book(listings: DataFrame, book: DataFrame) -> DataFrame:
    """Left join on the exact key: book columns are null where the book has none."""
    rows = book.select(F.col("k").alias("_k"), *BOOK)
    return listings.join(rows, F.col("key") == F.col("_k"), "left").withColumn("matched", F.col("_k").isNotNull()).drop("_k")


def _grade(key: Column) -> tuple[Column, Column, Column]:
    """(identity before the grade, grader, number) of a key; null where the last part is no grade."""
    last = F.substring_index(key, "|", -1)
    shape = r"^([A-Za-z]+)(10|[1-9](?:\.5)?)$"
    ok = last.rlike(shape) & key.contains("|")
    return F.when(ok, F.substr(key, F.lit(1), F.length(key) - F.length(last) - 1)), F.when(ok, F.upper(F.regexp_extract(last, shape, 1))), F.when(ok, F.regexp_extract(last, shape, 2))


def ladder_rungs(rungs: DataFrame) -> DataFrame:
    """Usable rungs (rung, mult): finite and above zero."""
    return rungs.filter((F.col("mult") > 0) & ~F.isnan("mult") & (F.col("mult") < float("inf"))).select("rung", "mult")


def _multiplier(key: Column, rungs: Column) -> Column:
    """Multiplier of a key's grade: by number, else by the grade as written, else in capitals."""
    token = F.substring_index(key, "|", -1)
    return F.coalesce(*[F.try_element_at(rungs, by) for by in (F.coalesce(_grade(key)[2], F.lit("")), token, F.upper(token))])


def with_ladder(listings: DataFrame, book: DataFrame, rungs: DataFrame) -> DataFrame:
    """Price unmatched graded keys from another grade of the same identity and grader.

    The source is the row with most sales, then the smallest key; med, lo and hi scale by the ratio of
    the rungs and round half up. basis_key names the source, ladder marks such rows.
    """
    # a grading scale has tens of rungs: the map is a constant of the plan
    scale = {r["rung"]: r["mult"] for r in ladder_rungs(rungs).limit(MOST_RUNGS + 1).collect() if r["rung"] is not None}
    if len(scale) > MOST_RUNGS:
        raise ValueError(f"a grading scale has at most {MOST_RUNGS} rungs")
    steps = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv]).cast("map<string,double>")
    base, grader, _ = _grade(F.col("k"))
    sources = book.filter(F.col("v").isin(*C.GRADED)).withColumn("_base", base).withColumn("_grader", grader).filter("_base IS NOT NULL")
    sources = sources.withColumn("_mult", _multiplier(F.col("k"), steps)).filter("_mult IS NOT NULL")
    best = sources.groupBy(F.col("v").alias("_v"), "_base", "_grader").agg(F.min_by(F.struct("k", "_mult", *BOOK), F.struct(-F.col("n"), F.col("k"))).alias("_s"))
    base, grader, _ = _grade(F.col("key"))
    wants = ~F.col("matched") & F.col("vertical").isin(*C.GRADED)
    asked = listings.withColumn("_lb", F.when(wants, base)).withColumn("_lg", F.when(wants, grader))
    asked = asked.withColumn("_own", _multiplier(F.col("key"), steps))
    out = asked.join(best, (F.col("vertical") == F.col("_v")) & (F.col("_lb") == F.col("_base")) & (F.col("_lg") == F.col("_grader")), "left")
    hit = F.col("_s").isNotNull() & F.col("_own").isNotNull()
    ratio = F.col("_own") / F.col("_s._mult")
    scaled = {c: F.when(hit, half_up(F.col(f"_s.{c}") * ratio).cast("double")).otherwise(F.col(c)) for c in ("med", "lo", "hi")}
    same = {c: F.when(hit, F.col(f"_s.{c}")).otherwise(F.col(c)) for c in BOOK if c not in scaled}
    return out.withColumns(scaled | same | {"ladder": hit, "basis_key": F.when(hit, F.col("_s.k"))}).drop("_lb", "_lg", "_own", "_v", "_base", "_grader", "_s")


#: Fixed values: (class, pattern over the title), in order.
CLASSES = (
    ("trex-tooth", r"\b(?:t[- ]?rex|tyrannosaur\w*)\b.*\btooth|\btooth\b.*\b(?:t[- ]?rex|tyrannosaur\w*)\b"),
    ("megalodon-tooth", r"\bmegalodon\b"),
    ("mosasaur-tooth", r"\bmosasaur\w*\b"),
    ("raptor-claw", r"\braptor\b.*\bclaw|\bclaw\b.*\braptor\b"),
    ("ammonite", r"\bammonite\b"),
    ("trilobite", r"\btrilobite\b"),
    ("dinosaur-egg", r"\bdinosaur\b.*\begg|\begg\b.*\bdinosaur\b"),
    ("meteorite", r"\bmeteorite\b"),
    ("apple-1", r"\bapple[- ]?(?:1|one)\b"),
    ("apple-ii", r"\bapple[- ]?(?:2|ii)\b"),
    ("macintosh-vintage", r"\bmacintosh\b|\bmac\b.*\b(?:128k|512k|plus|se)\b"),
)
SIGNED = r"\bsigned\b|\bautograph"
GAME_USED = r"\bgame[- ](?:used|worn)\b"


def class_of(title: Column) -> Column:
    return I.first_of(title, [(regex, name) for name, regex in CLASSES])


def leading_player(title: Column) -> Column:
    """Slug of the first two tokens if both look like names."""
    tokens = F.split(F.trim(title), r"\s+")
    pair = [F.get(tokens, F.lit(i)) for i in (0, 1)]
    bare = [F.regexp_replace(t, "[.,]+$", "") for t in pair]
    named = bare[0].rlike(I.NAME_TOKEN) & bare[1].rlike(I.NAME_TOKEN)
    return F.when(named, F.nullif(slug(F.concat_ws(" ", *pair)), F.lit("")))


def with_context(listings: DataFrame, context: DataFrame, hint: Column) -> DataFrame:
    """Rollup of the title's class, else of its signer if signed, else of its player if game-used and hunted as sports.

    A class without a rollup doesn't end the search. context: (kind, k, med, lo, hi, n, last_sale); of rows that
    share kind and k the last by a column `ord` counts, or without one the largest by all fields.
    """
    asks = (
        ("class", class_of(F.col("title"))),
        ("signer", F.when(has(F.col("title"), SIGNED), F.nullif(slug(I.signer()), F.lit("")))),
        ("player-object", F.when((hint == "sports") & has(F.col("title"), GAME_USED), F.concat(leading_player(F.col("title")), F.lit("|game-used")))),
    )
    out = listings.withColumns({f"_ask{i}": ask for i, (_, ask) in enumerate(asks)})
    fields = ("kind", "k", "med", "lo", "hi", "n", "last_sale")
    last = F.col("ord") if "ord" in context.columns else F.struct(*fields)
    for i, (kind, _) in enumerate(asks):
        rows = context.filter(F.col("kind") == kind).groupBy(F.col("k").alias(f"_k{i}")).agg(F.max_by(F.struct(*fields), last).alias(f"_c{i}"))
        out = out.join(rows, F.col(f"_ask{i}") == F.col(f"_k{i}"), "left")
    return out.withColumn("context", F.coalesce("_c0", "_c1", "_c2")).drop(*[f"_{x}{i}" for x in ("ask", "k", "c") for i in range(3)])


def prefix_rows(entries: DataFrame, book: DataFrame, conf: C.Config) -> DataFrame:
    """(hunt_id, k, place): for each entry's key prefix the dearest book rows.

    A prefix is matched by equality on its length: the book's keys are cut to the few lengths that
    entries use, so the join is by hash and not by a nested loop.
    """
    asked = entries.select("hunt_id", "key_prefix", F.length("key_prefix").alias("_len")).filter("key_prefix IS NOT NULL")
    lengths = asked.select("_len").distinct()
    cut = book.select("k", "med").join(F.broadcast(lengths), F.length("k") >= F.col("_len")).withColumn("_cut", F.substr("k", F.lit(1), F.col("_len")))
    hits = cut.join(asked.drop("_len"), F.col("_cut") == F.col("key_prefix"))
    w = Window.partitionBy("hunt_id").orderBy(F.col("med").desc(), "k")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= conf.prefix_cap).select("hunt_id", "k", "place")


#: Words that a query's title need not hold, and what a vertical's titles look like.
QUERY_STOP = ("the", "a", "an", "and", "of", "for", "with")
VERTICAL_HINT = {
    "sports-cards": r"\b(card|cards|psa|bgs|sgc|cgc|rookie|rc|refractor|prizm|topps|bowman|#\s?[a-z0-9]+)\b",
    "pokemon": r"\b(pokemon|pok[eé]mon|psa|cgc|bgs|charizard|holo)\b",
    "art-editions": r"\b(print|lithograph|screenprint|etching|edition|poster|multiple)\b",
    "autographs": r"\b(signed|autograph(?:ed)?|als|tls|psa\/dna|jsa|beckett)\b",
    "sports": r"\b(game[- ](?:used|worn)|jersey|photo[- ]?match)",
    "science": r"\b(fossil|meteorite|apple|computer|prototype|nasa|flown|patent|manual)\b",
}


def query_tokens(q: Column) -> Column:
    return F.filter(F.split(F.lower(q), r"\s+"), lambda w: (w != "") & ~w.isin(*QUERY_STOP))


#: Characters of the parts of words that are counted, and by which the words that may begin at a place of a title are found.
GRAM = 4
#: Titles with a word that one task takes; entries of a more frequent word go to as many tasks as that needs.
SHARE = 1 << 16
#: Word beginnings that are broadcast; more are met by a shuffle.
MOST_STARTS = 500_000


def _grams(words: Column) -> Column:
    """All parts of one to GRAM characters of words, each once."""
    def of(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(*[of(w, n) for n in range(1, GRAM + 1)]))))


def _rarest_words(titles: DataFrame, worded: DataFrame) -> DataFrame:
    """Entries with _word and _also, their two rarest words (the same if there is one), and _n, titles that may have _word.

    A word is taken to be as frequent as its rarest part of GRAM characters, of equals the longest is the rarest; entries
    with a part that no title has are left out.
    """
    own = [c for c in worded.columns if c != "_words"]
    parts = titles.select(F.explode(_grams(F.split(F.lower("title"), r"\s+"))).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_n"))
    words = worded.select(F.explode("_words").alias("_word")).distinct()
    cut = words.select("_word", F.explode(F.filter(_grams(F.array("_word")), lambda g: F.length(g) == F.least(F.lit(GRAM), F.length("_word")))).alias("_gram"))
    bound = cut.join(parts, "_gram", "left").groupBy("_word").agg(F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
    # the sizes of exploded rows are not foreseen, so no side may be chosen for a broadcast
    known = worded.select(*own, F.explode(F.array_distinct("_words")).alias("_word")).join(bound.hint("merge"), "_word")
    ranked = known.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("_n", (-F.length("_word")).alias("l"), "_word"))).alias("_by"))
    first, second = F.get("_by", F.lit(0)), F.get("_by", F.lit(1))
    return ranked.filter(first["_n"] > 0).select(*own, first["_word"].alias("_word"), F.coalesce(second["_word"], first["_word"]).alias("_also"), first["_n"].alias("_n"))


def _met(titles: DataFrame, worded: DataFrame) -> DataFrame:
    """titles joined to the entries whose rarest word they hold, and whose second rarest."""
    kept = scratch.kept(_rarest_words(titles, worded).withColumns({"_gram": F.substring("_word", 1, GRAM), "_len": F.length("_word")}), "entries")
    lengths = kept.groupBy("_gram", "_len").agg(F.ceil(F.max("_n") / SHARE).alias("_slots"))
    starts = lengths.groupBy("_gram").agg(F.collect_list(F.struct("_len", "_slots")).alias("_ends"))
    starts = F.broadcast(starts) if starts.limit(MOST_STARTS + 1).count() <= MOST_STARTS else starts.hint("merge")
    size, at = F.length("_low"), F.col("_at")
    places = titles.withColumns({"_low": F.lower("title"), "_part": F.xxhash64(*[c for c, kind in titles.dtypes if "map<" not in kind])}).filter(size > 0)
    places = places.withColumn("_at", F.explode(F.sequence(F.lit(1), size)))
    begun = places.withColumn("_gram", F.explode(F.array(*[F.when(at + (n - 1) <= size, F.substring(F.col("_low"), at, F.lit(n))) for n in range(1, GRAM + 1)]))).join(starts, "_gram")
    ends = begun.withColumn("_end", F.explode("_ends")).filter(at + F.col("_end._len") - 1 <= size).withColumn("_word", F.substring(F.col("_low"), at, F.col("_end._len")))
    once = ends.filter(F.instr(F.col("_low"), F.col("_word")) == at).withColumn("_slot", F.pmod("_part", F.col("_end._slots")))
    dealt = kept.join(lengths.hint("merge"), ["_gram", "_len"]).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1)))
    both = once.select(*titles.columns, "_low", "_word", "_slot").join(dealt.drop("_gram", "_len", "_slots", "_n").hint("merge"), ["_word", "_slot"])
    return both.filter(F.contains("_low", "_also")).drop("_low", "_word", "_slot", "_also")


def relevant_pairs(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """titles joined to the entries that relevant() lets them suit, for any number of entries.

    titles: with `title`; entries: hunt_id, q, title_must, title_not, vertical. Every word of a query is a part of a
    title's word, so the two share the whole of the query's rarest word: they meet there and nowhere else, and an entry
    with a part that no title has meets nothing. Entries whose query has no words meet every title; they are an array on
    each row, and more than 64 of them are an error.
    """
    asked = entries.select("hunt_id", "q", "title_must", "title_not", "vertical").withColumn("_words", F.when(F.col("q").isNotNull(), query_tokens(F.col("q"))))
    met = _met(titles, asked.filter(F.size("_words") > 0))
    few = asked.filter(F.col("_words").isNull() | (F.size("_words") == 0)).drop("_words").limit(65).collect()
    if len(few) > 64:
        raise ValueError("more than 64 entries without words")
    if few:
        kind = [F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in ("hunt_id", "q", "title_must", "title_not", "vertical")]) for r in few]
        met = met.unionByName(titles.withColumn("_e", F.explode(F.array(*kind))).select(*titles.columns, "_e.*"))
    return met.filter(relevant(F.col("title"), F.col("q"), F.col("title_must"), F.col("title_not"), F.col("vertical")))


def relevant(title: Column, q: Column, must: Column, unwanted: Column, vertical: Column) -> Column:
    """Whether a hit suits its hunt entry: its patterns, all words of its query, and its vertical's look.

    Patterns are per row; q is null for entries that name a key or prefix.
    """
    low = F.lower(title)
    words = F.forall(query_tokens(q), lambda w: F.contains(low, w))
    look = F.lit(True)
    for name, regex in VERTICAL_HINT.items():
        look = F.when(vertical == name, has(title, regex)).otherwise(look)
    fits = F.when(must.isNotNull(), F.regexp(title, F.concat(F.lit("(?i)"), must))).otherwise(F.lit(True))
    barred = F.when(unwanted.isNotNull(), F.regexp(title, F.concat(F.lit("(?i)"), unwanted))).otherwise(F.lit(False))
    return fits & ~barred & (q.isNull() | (words & (must.isNotNull() | look)))
