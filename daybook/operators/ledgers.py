"""Charts of accounts: filters, search, merging and matching transactions to ledgers.

Matching never pairs all transactions with all ledgers. Exact tiers are equi
joins; "is contained in" is an equi join on each short text's rarest run of
characters, then checked; shared words are equi joins on rare words, and for
words that very many names share on the few best names per set of such words.
Work is done once per distinct party or narration, and of each one's candidates
only the best few are kept, by a row limit that Spark applies before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions import entities
from daybook.functions.scalars import normalize_ledger_name
from daybook.keys import join_by_key
from daybook.storage import written_sized

# Ledgers of statutory parties, and other names they go by.
STATUTORY = ("Bank Charges", "Bank Interest Income", "Bank Interest Expense", "GST Input Tax Credit", "APY Contribution", "Clearing")
OTHER_NAMES = (
    ("Bank Charges", "BANK CHARGES"), ("Bank Charges", "BANK COMMISSION"), ("Bank Charges", "BANK SERVICE CHARGES"),
    ("Bank Interest Income", "BANK INTEREST"), ("Bank Interest Income", "INTEREST RECEIVED"), ("Bank Interest Income", "INTEREST ON FD"),
    ("Bank Interest Expense", "INTEREST PAID"), ("Bank Interest Expense", "INTEREST ON OD"),
)
BANK_GROUPS = ("BANK ACCOUNTS", "BANK OCC", "BANK OD", "BANK A/C")
NOT_BANK_NAMES = ("BANK CHARGES", "BANK CHARGE", "BANK CHGS", "BANK INTEREST", "INTEREST ON")
NOT_BANK_GROUPS = ("DEBTOR", "CREDITOR", "EXPENSE", "INCOME")
CASH_NAMES = ("CASH", "PETTY CASH", "CASH IN HAND", "CASH-IN-HAND")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(*[c.contains(w).cast("int") for w in words], F.lit(0)) == 1


def _up(c: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))


def is_bank_ledger(name: str = "name", group: str = "grp", parent: str = "parent") -> Column:
    """In or below a bank group, and neither named nor grouped as expense, income or party."""
    g, p = _up(group), _up(parent)
    inside = _any(g, BANK_GROUPS) | _any(p, BANK_GROUPS) | g.contains("BANK")
    return ~_any(F.upper(F.col(name)), NOT_BANK_NAMES) & ~_any(g, NOT_BANK_GROUPS) & inside


def is_cash_ledger(name: str = "name", group: str = "grp", parent: str = "parent") -> Column:
    return _up(group).contains("CASH") | _up(parent).contains("CASH") | F.upper(F.col(name)).isin(*CASH_NAMES)


def search(ledgers: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Ledgers that fit a query, by rank: exact name or tax number, alias, beginning, inside, group, any word; then by ``ord``."""
    q, raw = " ".join(query.split()).upper(), query.strip().upper()
    norm, tax = normalize_ledger_name(F.col("name")), F.upper(F.coalesce("gstin", F.lit("")))
    rank = (
        F.when((norm == q) | ((tax != "") & (tax == raw)), 0)
        .when(F.coalesce(normalize_ledger_name(F.col("alias")), F.lit("")) == q, 1)
        .when(norm.startswith(q), 2)
        .when(norm.contains(q) | ((tax != "") & tax.contains(raw)), 3)
        .when(normalize_ledger_name(F.coalesce("grp", F.lit(""))).contains(q), 4)
        .when(_any(norm, tuple(q.split())), 5)
    )
    found = ledgers.withColumn("rank", rank).where(F.col("rank").isNotNull())
    return found if limit is None else found.orderBy("rank", "ord").limit(limit)


def with_parent_group(ledgers: DataFrame, groups: DataFrame) -> DataFrame:
    """The parent of each ledger's group, one level up; a group without parent is its own."""
    parents = groups.where(F.coalesce("parent", F.lit("")) != "").select(F.col("name").alias("g_name"), F.col("parent").alias("g_parent"))
    return ledgers.join(parents, F.col("grp") == F.col("g_name"), "left").withColumn("parent_group", F.coalesce("g_parent", "grp")).drop("g_name", "g_parent")


def merged(rows: DataFrame, key: str = "normalized_name", ord_col: str = "ord", lists: tuple[str, ...] = ("aliases",)) -> DataFrame:
    """One row per key: the first row's values, later rows fill only what is missing; lists are joined without repeats in order."""
    others = [c for c in rows.columns if c not in (key, ord_col, *lists)]
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ord_col))).alias(c) for c in others]
    joined = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(ord_col, F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias(c) for c in lists]
    return rows.groupBy(key).agg(F.min(ord_col).alias(ord_col), *first, *joined)


def group_conflicts(rows: DataFrame, key: str = "normalized_name") -> DataFrame:
    """Later rows whose group is neither Primary nor that of the key's first row."""
    first = rows.groupBy(key).agg(F.min_by("grp", "ord").alias("first_grp"), F.min("ord").alias("first_ord"))
    both = rows.join(first, key).where("ord > first_ord AND grp <> 'Primary' AND first_grp <> 'Primary' AND grp <> first_grp")
    return both.select(key, "ord", "first_grp", "grp")


def _index(ledgers: DataFrame) -> DataFrame:
    """Names by their normal form: the last of equal ones, in the place of the first."""
    return ledgers.groupBy(normalize_ledger_name(F.col("name")).alias("norm")).agg(F.max_by("name", "ord").alias("ledger"), F.min("ord").alias("ord"))


#: Candidates kept for a party: five to show and one that may be the exact name.
LISTED = 6
#: A word that more names than this share is common.
COMMON = 64
#: Of a name's common words, so many (its most common ones) are looked up as sets; further ones count as rare.
SETS_OF = 6


def containing(needles: DataFrame, needle: str, texts: DataFrame, text: str, width: int = 8) -> DataFrame:
    """Pairs where the text contains the needle: an equi join on one run of ``width`` characters of the needle
    (all of it if it is shorter), the one that fewest needles hold, then a check."""

    def runs(c: str, n: Column | int) -> Column:
        n = F.lit(n)
        return F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(F.col(c), i, n))

    own = needles.where(F.col(needle) != "").select(needle).distinct()
    size = F.least(F.length(needle), F.lit(width))
    held = own.select(needle, F.explode(F.array_distinct(runs(needle, size))).alias("run"))
    times = held.groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    rarest = held.join(times, "run").groupBy(needle).agg(F.min(F.struct("times", "run")).alias("least")).select(needle, F.col("least.run").alias("run"))
    keyed = needles.join(rarest, needle)
    # Which lengths of runs there are: at most `width` rows.
    sizes = sorted(r[0] for r in rarest.select(F.length("run")).distinct().collect())
    if not sizes:
        return texts.crossJoin(needles.limit(0))
    every = F.array_distinct(F.concat(*[F.when(F.length(text) >= n, runs(text, n)).otherwise(F.array().cast("array<string>")) for n in sizes]))
    cut = texts.withColumn("run", F.explode(every))
    return cut.join(keyed, "run").where(F.col(text).contains(F.col(needle))).drop("run")


def _best(scored: DataFrame, key: str, n: int = LISTED) -> DataFrame:
    """The first ``n`` rows of each key by minus, ord, ledger. Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy(key).orderBy("minus", "ord", "ledger")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def _sharing(parties: DataFrame, index: DataFrame) -> DataFrame:
    """(party_norm, norm, ledger, ord, words, names_words, common): names that share words with a party, enough of
    them for its best ``LISTED``.

    Names that share a rare word are found by it. What shares common words only
    is found by the set of these words: of the names that hold a set and have one
    number of words, no more than the first ``LISTED`` by ``ord`` can be among a
    party's best, since all of them share at least as much with it.
    """
    cut = lambda df, c: df.withColumn("words", F.array_distinct(F.split(c, " ")))
    names, p = cut(index, "norm"), cut(parties, "party_norm")
    counts = names.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    ranked = names.select("norm", F.explode("words").alias("word")).join(counts, "word")
    by_use = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("times"), "word"))
    ranked = ranked.withColumn("is_set", (F.col("times") > COMMON) & (by_use <= SETS_OF))

    rare = ranked.where(~F.col("is_set")).select("norm", "word").join(names, "norm")
    by_rare = p.withColumn("word", F.explode("words")).join(rare.withColumnRenamed("words", "name_words"), "word")
    by_rare = by_rare.select("party_norm", "words", "norm", "name_words", "ledger", "ord").distinct()

    sets = ranked.where("is_set").groupBy("norm").agg(F.array_sort(F.collect_list(F.struct(F.col("times"), "word"))).alias("used"))
    picks = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("used")).cast("int") - 1), lambda i: F.filter(F.col("used"), lambda x, at: F.pmod(F.floor(i / F.pow(F.lit(2), at)), F.lit(2)) == 1))
    named = sets.withColumn("pick", F.explode(picks)).join(names.withColumnRenamed("words", "name_words"), "norm")
    # The key's rarest word comes first, so a key of many words is looked up by one that few keys begin with.
    named = named.select(F.transform("pick", lambda x: x["word"]).alias("key"), "norm", "name_words", "ledger", "ord", F.size("name_words").alias("n"), F.lit(0).alias("minus"))
    kept = _best(named.withColumn("group", F.struct("key", "n")), "group").withColumn("word", F.col("key")[0])
    by_set = p.withColumn("word", F.explode("words")).join(kept, "word").where(F.size(F.array_except("key", "words")) == 0)
    both = by_rare.unionByName(by_set.select("party_norm", "words", "norm", "name_words", "ledger", "ord")).where("party_norm <> norm").distinct()
    return both.withColumn("common", F.size(F.array_intersect("words", "name_words")))


def candidates(parties: DataFrame, ledgers: DataFrame) -> DataFrame:
    """(party_norm, exact, listed): the exact ledger of a party and its best ``LISTED`` other candidates as
    (minus the score, ord, ledger), best first.

    Containment scores 88; shared words, at least half of the shorter name's,
    score 60 plus 25 times their share of the longer.
    """
    index = _index(ledgers)
    p = parties.select("party_norm").distinct()
    exact = p.join(index, F.col("party_norm") == F.col("norm")).select("party_norm", F.col("ledger").alias("exact"))
    inside = containing(p, "party_norm", index, "norm").select("party_norm", "norm", "ledger", "ord")
    reverse = containing(index, "norm", p, "party_norm").select("party_norm", "norm", "ledger", "ord")
    held = inside.unionByName(reverse).where("party_norm <> norm").select("party_norm", "ledger", "ord", F.lit(-88.0).alias("minus"))
    shared = _sharing(p, index)
    shorter, longer = F.least(F.size("words"), F.size("name_words")), F.greatest(F.size("words"), F.size("name_words"))
    shared = shared.where((F.col("common") >= shorter * 0.5) & ~F.col("norm").contains(F.col("party_norm")) & ~F.col("party_norm").contains(F.col("norm")))
    score = F.round(60.0 + F.col("common") / longer * 25.0, 1)
    best = _best(held.unionByName(shared.select("party_norm", "ledger", "ord", (-score).alias("minus"))).distinct(), "party_norm")
    listed = best.groupBy("party_norm").agg(F.array_sort(F.collect_list(F.struct("minus", "ord", "ledger"))).alias("listed"))
    return p.join(exact, "party_norm", "left").join(listed, "party_norm", "left")


def narration_matches(narrations: DataFrame, ledgers: DataFrame) -> DataFrame:
    """(narration_up, n_ledger, n_score): the best ledger that is a segment of the narration (92) or stands in it, from five characters on (88). Narrations may repeat."""
    index = _index(ledgers)
    n = narrations.select("narration_up")
    cut = n.withColumn("segment", F.explode(F.filter(F.transform(F.split("narration_up", "[/_:-]"), lambda x: F.trim(x)), lambda x: x != "")))
    segments = cut.join(index, F.col("segment") == F.col("norm")).select("narration_up", "ledger", "ord", F.lit(92.0).alias("score"))
    inside = containing(index.where(F.length("norm") >= 5), "norm", n, "narration_up").select("narration_up", "ledger", "ord", F.lit(88.0).alias("score"))
    best = segments.union(inside).groupBy("narration_up").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ord", "ledger")).alias("b"))
    return best.select("narration_up", F.col("b.ledger").alias("n_ledger"), (-F.col("b.minus")).alias("n_score"))


def _of_parties(facts: DataFrame, ledgers: DataFrame, rules: DataFrame) -> DataFrame:
    """Per party name of ``facts`` what its tiers need, and ``n_facts``: how many facts have it."""
    parties = facts.where(F.col("party_name").isNotNull()).groupBy("party_name").agg(F.count(F.lit(1)).alias("n_facts"))
    parties = written_sized(parties.withColumn("party_up", F.upper(F.trim("party_name"))).withColumn("party_norm", normalize_ledger_name(F.col("party_name"))), "party-names")
    by_party = rules.groupBy("pattern").agg(F.max_by("r_ledger", "r_ord").alias("rule_party")).withColumnRenamed("pattern", "party_up")
    names = candidates(parties.where(F.coalesce("party_norm", F.lit("")) != ""), ledgers)
    by_alias = ledgers.where(F.col("alias").isNotNull()).groupBy(normalize_ledger_name(F.col("alias")).alias("party_norm")).agg(F.max_by("name", "ord").alias("alias_ledger"))
    index = _index(ledgers)
    own = index.select(F.col("norm").alias("party_norm"), F.col("ledger").alias("own_name"))
    other = ledgers.sparkSession.createDataFrame([(a, b, i) for i, (a, b) in enumerate(OTHER_NAMES)], "party_name string, norm string, place int").join(index, "norm")
    other = other.groupBy("party_name").agg(F.min_by("ledger", "place").alias("other_name"))
    for side, key in ((by_party, "party_up"), (names, "party_norm"), (by_alias, "party_norm"), (own, "party_norm"), (other, "party_name")):
        parties = parties.join(side, key, "left")
    return written_sized(parties.drop("party_up", "party_norm"), "party-tiers")


def match(tx: DataFrame, ledgers: DataFrame, rules: DataFrame, cash: str = "Cash") -> DataFrame:
    """The ledger of every transaction by tiers: cash, saved rule of the party, saved rule in the narration, tax number,
    exact name, alias, close name, narration, statutory name, Suspense.

    Adds party_name, category, ledger_name, mapping_confidence, mapping_status and, for name tiers, up to five candidates.

    All of it follows from a narration and its side (debit or not), so the tiers
    are resolved once for each of these, those of parties once per party, and one
    join takes them back to the transactions. A narration or party that holds a
    large share of them is joined by a bounded broadcast (``join_by_key``); what
    has no party or tax number takes part in no join on it. Nothing else that
    grows with the input is broadcast (``written_sized``).
    """
    ledgers, rules = written_sized(ledgers, "ledgers"), written_sized(rules, "rules")
    tx, tax = written_sized(tx, "transactions"), entities.gstin(F.col("narration"))  # read for the facts and for the join back
    facts = tx.groupBy("narration", (F.col("debit") > 0).alias("is_debit")).agg(F.count(F.lit(1)).alias("n_rows"))
    found = entities.party(F.col("narration"), F.col("is_debit"))
    is_cash = entities.cash_type(F.col("narration"), F.col("is_debit")).isNotNull() | (F.coalesce(F.upper(F.trim("party.name")), F.lit("")) == "CASH")
    # few bytes but much work a row: dealt to as many tasks as shuffles have, which adaptive execution would make one of
    facts = facts.repartition(int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    facts = facts.withColumn("party", found).withColumn("is_cash", is_cash).withColumn("tax", tax).withColumn("fact", F.monotonically_increasing_id())
    facts = written_sized(facts.select("fact", "narration", "is_debit", "n_rows", F.upper("narration").alias("narration_up"), "party.name", "party.category", "is_cash", "tax").withColumnRenamed("name", "party_name"), "facts")

    rule = rules.select(F.upper(F.trim("pattern")).alias("pattern"), F.col("ledger").alias("r_ledger"), F.col("ord").alias("r_ord"))
    said = containing(rule, "pattern", facts.select("narration_up"), "narration_up")
    by_text = said.groupBy("narration_up").agg(F.min_by("r_ledger", "r_ord").alias("rule_text"))
    by_tax = ledgers.where(F.col("gstin").isNotNull()).groupBy(F.upper(F.trim("gstin")).alias("tax")).agg(F.max_by("name", "ord").alias("tax_ledger"))
    of_party = _of_parties(facts, ledgers, rule)
    n_facts = facts.count()
    taxed = facts.where(F.col("tax").isNotNull()).select("fact", "tax").join(by_tax, "tax").select("fact", "tax_ledger")
    with_party = join_by_key(facts.where(F.col("party_name").isNotNull()), of_party, "party_name", "n_facts", n_facts)
    wide = with_party.drop("n_facts").unionByName(facts.where(F.col("party_name").isNull()), allowMissingColumns=True)
    wide = wide.join(taxed, "fact", "left").join(by_text, "narration_up", "left").join(narration_matches(facts, ledgers), "narration_up", "left")
    top = F.get("listed", F.lit(0))
    close = F.col("listed").isNotNull() & (-top["minus"] >= 80.0)
    statutory = F.col("party_name").isin(*STATUTORY)
    pick = lambda ledger, score, status: F.struct((F.lit(ledger) if isinstance(ledger, str) else ledger).alias("ledger"), (F.lit(score) if isinstance(score, float) else score).alias("score"), F.lit(status).alias("status"))
    tier = (
        F.when(F.col("is_cash"), pick(cash, 99.0, "Auto"))
        .when(F.col("rule_party").isNotNull(), pick(F.col("rule_party"), 100.0, "Previously Mapped"))
        .when(F.col("rule_text").isNotNull(), pick(F.col("rule_text"), 95.0, "Previously Mapped"))
        .when(F.col("tax_ledger").isNotNull(), pick(F.col("tax_ledger"), 99.0, "Auto"))
        .when(F.col("exact").isNotNull(), pick(F.col("exact"), 100.0, "Auto"))
        .when(F.col("alias_ledger").isNotNull(), pick(F.col("alias_ledger"), 100.0, "Auto"))
        .when(close, pick(top["ledger"], -top["minus"], "Auto"))
        .when(F.col("n_ledger").isNotNull(), pick(F.col("n_ledger"), F.col("n_score"), "Auto"))
        .when(statutory & F.col("own_name").isNotNull(), pick(F.col("own_name"), 95.0, "Auto"))
        .when(statutory & F.col("other_name").isNotNull(), pick(F.col("other_name"), 92.0, "Auto"))
        .when(statutory, pick(F.col("party_name"), 90.0, "Auto"))
        .otherwise(pick("Suspense", 0.0, "Suspense"))
    )
    listed = F.slice(F.transform("listed", lambda x: x["ledger"]), 1, 5)
    listed = F.when(F.col("exact").isNotNull(), F.slice(F.concat(F.array("exact"), F.filter(F.coalesce(F.transform("listed", lambda x: x["ledger"]), F.array().cast("array<string>")), lambda x: x != F.col("exact"))), 1, 5)).otherwise(listed)
    resolved = wide.withColumn("tier", tier).select(
        F.struct("narration", "is_debit").alias("fact_key"), "n_rows", "party_name", "category",
        F.col("tier.ledger").alias("ledger_name"), F.col("tier.score").alias("mapping_confidence"), F.col("tier.status").alias("mapping_status"), listed.alias("candidates"),
    )
    resolved = written_sized(resolved.withColumn("fact_key", _key("fact_key.narration", "fact_key.is_debit")), "resolved")
    total = resolved.agg(F.sum("n_rows")).first()[0] or 0
    keyed = tx.withColumn("fact_key", _key("narration", F.col("debit") > 0))
    return join_by_key(keyed, resolved, "fact_key", "n_rows", total).drop("fact_key", "n_rows")


def _key(narration: str, is_debit: str | Column) -> Column:
    """A text that is equal for equal pairs, nulls included."""
    side = F.col(is_debit) if isinstance(is_debit, str) else is_debit
    return F.concat(F.when(side, "D").when(~side, "C").otherwise("N"), F.when(F.col(narration).isNull(), "-").otherwise("+"), F.coalesce(F.col(narration), F.lit("")))


def keep_confirmed(matched: DataFrame, given: str) -> DataFrame:
    """A ledger that a user gave, other than Suspense, stays and counts as confirmed."""
    own = F.col(given).isNotNull() & (F.trim(given) != "") & (F.col(given) != "Suspense")
    out = {"ledger_name": F.when(own, F.col(given)).otherwise(F.col("ledger_name")), "mapping_status": F.when(own, "User Confirmed").otherwise(F.col("mapping_status")), "mapping_confidence": F.when(own, 100.0).otherwise(F.col("mapping_confidence"))}
    return matched.select(*[out.get(c, F.col(c)).alias(c) for c in matched.columns])
