"""Best representative of each group of duplicate records, built from whole bundles of fields.

Fields that depend on each other form a bundle and are taken together from one record. For each group the choice of one
bundle value per bundle is searched that maximises the sum of the trust of the records they come from, under functional
dependencies between bundles; ties go to the bundle of best rank, in the order the bundles are given.

The search is branch and bound. Its root relaxation drops the dependencies, so every bundle takes its best usable
record: this is one aggregation with map-side partial results, safe for a group that holds any share of all rows. A
group whose relaxed choice meets all dependencies is solved, since the bound is reached. Only the others branch: over
the distinct values of each bundle in rank order, in levels of a few candidates a bundle, deepened until the bound of
what has not been seen can no longer beat the best choice found. Before that, candidates of a bundle that no dependency
tells apart are pruned to the best of them: those with the same left value, if it determines anything, and the same right
value, if anything determines it. So a group of any size branches over no more candidates than its dependencies have
distinct values, and one more.

Defined results: groups of fewer than two records give no row; a null or blank key makes no group; a bundle without a
usable record gives null fields; exact repeats of a record count as records and the smallest id stands for them; a null
trust counts as 0 and a null time as the oldest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logothek.operators import skew
from logothek.session import checkpointed


@dataclass(frozen=True)
class Bundle:
    """Fields taken together, and the condition under which a record's values can be used (None: none of them is null)."""

    name: str
    fields: tuple[str, ...]
    usable: Column | None = None

    def condition(self) -> Column:
        c = self.usable
        if c is None:
            c = F.lit(True)
            for f in self.fields:
                c = c & F.col(f).isNotNull()
        return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Dependency:
    """Within a group, ``left`` (a field) determines ``right`` (a field of another bundle).

    The value a left value determines is that of the best-ranked record which holds the left value and a usable right one.
    """

    left: str
    right: str


def search(candidates: dict[str, list[tuple]], determined: dict[tuple[str, str], dict], bundles: list[tuple[str, tuple[str, ...]]], dependencies: list[tuple[str, str]]) -> tuple[tuple, list[tuple | None]]:
    """Branch and bound for one group.

    candidates: by bundle, (trust, rank, values) in order of (-trust, rank). determined: by dependency, left value to right
    value. Returns the objective and the choice of each bundle (None: it has no candidate that fits). A bundle that has
    candidates takes one of them if any choice at all meets the dependencies, else stays empty at a loss of all trust.
    """
    owner = {f: (i, k) for i, (_, fields) in enumerate(bundles) for k, f in enumerate(fields)}
    tops = [candidates[n][0][0] if candidates[n] else 0 for n, _ in bundles]
    rest = [sum(tops[i:]) for i in range(len(bundles) + 1)]
    best: list = [None, None]

    def fits(chosen: list, i: int) -> bool:
        for d in dependencies:
            (a, ka), (b, kb) = owner[d[0]], owner[d[1]]
            if max(a, b) == i and chosen[a] is not None and chosen[b] is not None:
                right = determined[d].get(chosen[a][2][ka])
                if right is not None and right != chosen[b][2][kb]:
                    return False
        return True

    def branch(i: int, chosen: list, trust: int, ranks: tuple) -> None:
        if i == len(bundles):
            value = (trust, tuple(-r for r in ranks))
            if best[0] is None or value > best[0]:
                best[:] = [value, list(chosen)]
            return
        for c in [*candidates[bundles[i][0]], None]:
            bound = trust + (c[0] if c else 0) + rest[i + 1]
            if best[0] is not None and bound < best[0][0]:
                break  # candidates come in order of falling trust
            chosen.append(c)
            if fits(chosen, i):
                branch(i + 1, chosen, trust + (c[0] if c else 0), (*ranks, c[1] if c else 1 << 62))
            chosen.pop()

    branch(0, [], 0, ())
    return best[0], best[1]


def _solver(keys: list[str], names: list[tuple[str, tuple[str, ...]]], wanted: list[tuple[str, str]], seen_now: int):
    """The search over one group's candidates, of which ``seen_now`` a bundle are used and one more tells the bound of the rest."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fields = dict(names)
        cand: dict[str, list] = {n: [] for n, _ in names}
        unseen = {}
        own = pdf[pdf["_bundle"].notna()].sort_values(["_bundle", "t", "u", "r"], kind="stable")
        for name, t, values in own[["_bundle", "t", "_values"]].itertuples(index=False):
            v = json.loads(values)
            if len(cand[name]) == seen_now:
                unseen[name] = -int(t)
            else:
                cand[name].append((-int(t), len(cand[name]), tuple(v.get(f) for f in fields[name])))
        determined: dict = {d: {} for d in wanted}
        for i, fact in pdf.loc[pdf["_bundle"].isna(), ["_d", "_values"]].itertuples(index=False):
            x = json.loads(fact)
            determined[wanted[int(i)]][x.get("l")] = x.get("r")
        value, choice = search(cand, determined, names, wanted)
        tops = {n: (cand[n][0][0] if cand[n] else 0) for n, _ in names}
        # what has not been seen has at most this trust, and a worse rank than all that was seen: at equal trust it loses
        # if every bundle before has its best candidate
        proven = True
        for i, (n, _) in enumerate(names):
            bound = sum(tops.values()) - tops[n] + unseen[n] if n in unseen else -1
            proven &= bound < value[0] or (bound == value[0] and not any(value[1][:i]))
        got = {f: v for (n, fs), c in zip(names, choice, strict=True) for f, v in zip(fs, c[2] if c else [None] * len(fs), strict=True)}
        return pd.DataFrame([[*key, json.dumps(got, ensure_ascii=False), proven]], columns=[*keys, "_chosen", "_proven"])

    return solve


def survivors(
    records: DataFrame,
    keys: list[str],
    bundles: list[Bundle],
    trust: str,
    time: str,
    row_id: str,
    dependencies: Iterable[Dependency] = (),
    level: int = 32,
) -> DataFrame:
    """One row for each group of two or more records: keys, ``group_id`` (smallest id), ``n_records`` and the fields chosen.

    records: keys, fields, ``trust`` (int, higher is better), ``time`` (later is better) and ``row_id`` (unique long).
    level: candidates of each bundle that the first round of branching sees; it doubles until every group is proven.
    """
    dependencies = list(dependencies)
    for k in keys:
        records = records.where(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    rank = [(-F.coalesce(F.col(trust).cast("int"), F.lit(0))).alias("t"), (-F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62)))).alias("u"), F.col(row_id).alias("r")]
    best = [F.min(F.when(b.condition(), F.struct(*rank, *[F.col(f).alias(f) for f in b.fields]))).alias(f"_{b.name}") for b in bundles]
    relaxed = records.groupBy(*keys).agg(F.count("*").alias("n_records"), F.min(row_id).alias("group_id"), *best).where("n_records > 1")
    columns = [*keys, "group_id", "n_records", *[f for b in bundles for f in b.fields]]
    if dependencies:
        # what follows needs the records of groups alone: most are the only one of their key
        relaxed = checkpointed(relaxed)
        grouped = relaxed.select(*keys)
        if skew.small_enough(grouped):
            records = checkpointed(records.join(F.broadcast(grouped), keys, "left_semi"))
        else:
            records = checkpointed(skew.salted_join(records, grouped, keys, salt_by=row_id, how="left_semi", hot=skew.hot_of_counts(relaxed, keys, "n_records")))
    chosen = relaxed.select(*keys, "group_id", "n_records", *[F.col(f"_{b.name}.{f}").alias(f) for b in bundles for f in b.fields])
    if not dependencies:
        return chosen.select(*columns)

    # dependencies: what each left value determines, from its best record, again by partial aggregation
    known = {}
    for d in dependencies:
        right = next(b for b in bundles if d.right in b.fields)
        known[d] = (
            records.where(right.condition() & F.col(d.left).isNotNull())
            .groupBy(*keys, F.col(d.left).alias("_left"))
            .agg(F.min(F.struct(*rank, F.col(d.right).alias("v"))).alias("_m"))
            .select(*keys, "_left", F.col("_m.v").alias("_right"))
        )
    checked = chosen
    broken = F.lit(False)
    for i, (d, known_d) in enumerate(known.items()):
        checked = checked.join(known_d.select(*keys, F.col("_left").alias(d.left), F.col("_right").alias(f"_want{i}")), [*keys, d.left], "left")
        broken = broken | F.coalesce(F.col(f"_want{i}") != F.col(d.right), F.lit(False))
    checked = checkpointed(checked.select(*columns, broken.alias("_broken")))
    solved = checked.where(~F.col("_broken")).select(*columns)
    open_groups = checked.where("_broken").select(*keys, "group_id", "n_records")

    # branching: distinct values of each bundle with their best rank, pruned to one for all that no dependency tells apart
    open_keys = open_groups.select(*keys)
    known = {d: checkpointed(known_d.join(open_keys, keys, "left_semi")) for d, known_d in known.items()}
    parts = []
    for b in bundles:
        values = records.where(b.condition()).join(open_keys, keys, "left_semi").groupBy(*keys, *b.fields).agg(F.min(F.struct(*rank)).alias("_rank"))
        signature = []
        for i, (d, known_d) in enumerate(known.items()):
            for side, field in (("_left", d.left), ("_right", d.right)):
                if field in b.fields:
                    told = known_d.select(*keys, F.col(side).alias(field)).distinct().withColumn(f"{side}{i}", F.lit(True))
                    values = values.join(told, [*keys, field], "left")
                    signature.append(F.when(F.col(f"{side}{i}"), F.col(field)).alias(f"_same{len(signature)}"))
        best = values.groupBy(*keys, *signature).agg(F.min(F.struct("_rank", *b.fields)).alias("_best"))
        parts.append(best.select(*keys, F.lit(b.name).alias("_bundle"), F.col("_best._rank").alias("_rank"), F.to_json(F.struct(*[F.col(f"_best.{f}").alias(f) for f in b.fields]), {"ignoreNullFields": "false"}).alias("_values")))
    candidates = parts[0]
    for p in parts[1:]:
        candidates = candidates.unionByName(p)
    candidates = checkpointed(candidates.withColumn("_slot", F.pmod(F.xxhash64("_values"), F.lit(64)).cast("int")))
    facts = None
    for i, (d, known_d) in enumerate(known.items()):
        part = known_d.select(*keys, F.lit(i).alias("_d"), F.to_json(F.struct(F.col("_left").alias("l"), F.col("_right").alias("r"))).alias("_fact"), F.col("_left").cast("string").alias("_text"))
        facts = part if facts is None else facts.unionByName(part)
    facts = checkpointed(facts)

    names = [(b.name, b.fields) for b in bundles]
    wanted = [(d.left, d.right) for d in dependencies]
    kinds = {f.name: f.dataType for f in records.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k].simpleString()}" for k in keys), "_chosen string", "_proven boolean"])

    while True:
        salted = Window.partitionBy(*keys, "_bundle", "_slot").orderBy("_rank")
        whole = Window.partitionBy(*keys, "_bundle").orderBy("_rank")
        seen = candidates.withColumn("_k", F.row_number().over(salted)).where(F.col("_k") <= level + 1).withColumn("_k", F.row_number().over(whole)).where(F.col("_k") <= level + 1)
        lefts = None
        for i, d in enumerate(dependencies):
            bundle = next(b for b in bundles if d.left in b.fields)
            part = seen.where(F.col("_bundle") == bundle.name).select(*keys, F.lit(i).alias("_d"), F.get_json_object("_values", f"$.{d.left}").alias("_text")).distinct()
            lefts = part if lefts is None else lefts.unionByName(part)
        used = facts.join(lefts, [*keys, "_d", "_text"], "left_semi")
        rows = seen.select(*keys, "_bundle", F.col("_rank.t").alias("t"), F.col("_rank.u").alias("u"), F.col("_rank.r").alias("r"), "_values", F.lit(None).cast("int").alias("_d")).unionByName(
            used.select(*keys, F.lit(None).cast("string").alias("_bundle"), F.lit(None).cast("int").alias("t"), F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("r"), F.col("_fact").alias("_values"), "_d")
        )

        solve = _solver(keys, names, wanted, level)
        result = checkpointed(rows.groupBy(*keys).applyInPandas(solve, schema))
        shape = ", ".join(f"`{f}` {kinds[f].simpleString()}" for b in bundles for f in b.fields)
        done = result.where("_proven").join(open_groups, keys).select(*keys, "group_id", "n_records", F.from_json("_chosen", shape).alias("_c")).select(*keys, "group_id", "n_records", *[F.col(f"_c.{f}").alias(f) for b in bundles for f in b.fields])
        solved = solved.unionByName(done.select(*columns))
        left = result.where("NOT _proven").select(*keys)
        if left.isEmpty():
            return solved
        candidates = candidates.join(left, keys, "left_semi")
        facts = facts.join(left, keys, "left_semi")
        open_groups = open_groups.join(left, keys, "left_semi")
        level = math.ceil(level * 2)


def folded_label(c: Column) -> Column:
    """A label without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def lexicon_records(lookup: DataFrame, lemmas: DataFrame, sources: DataFrame) -> DataFrame:
    """(row_id, lang, form, lemma_id, src, _trust, updated_at): a ``lemma_id`` that ``lemmas`` lacks and an unknown ``src`` become null.

    ``src`` is the label as written in ``sources``. Ids are broadcast only if at most ``skew.BROADCAST_ROWS`` of them are
    there, else joined with salted hot ids.
    """
    labels = sources.select(folded_label(F.col("src")).alias("_label"), F.col("src").alias("_src"), F.col("trust").cast("int").alias("_trust")).dropna(subset=["_label"]).groupBy("_label").agg(F.min(F.struct((-F.coalesce("_trust", F.lit(0))).alias("_less"), "_src")).alias("m")).select("_label", F.col("m._src").alias("_src"), (-F.col("m._less")).alias("_trust"))
    ids = lemmas.select(F.col("id").cast("long").alias("lemma_id")).dropna().distinct().withColumn("_known", F.lit(True))
    rows = lookup.select("row_id", "form", "lemma_id", folded_label(F.col("src")).alias("_label"), "lang", "updated_at")
    rows = rows.join(F.broadcast(labels) if skew.small_enough(labels) else labels, "_label", "left").drop("_label")
    if skew.small_enough(lemmas):
        rows = rows.join(F.broadcast(ids), "lemma_id", "left")
    else:
        rows = skew.salted_join(rows, ids, ["lemma_id"], salt_by="row_id", how="left")
    return rows.select("row_id", "lang", "form", F.when(F.col("_known"), F.col("lemma_id")).alias("lemma_id"), F.col("_src").alias("src"), "_trust", "updated_at")


BUNDLES = (Bundle("lemma", ("lemma_id",)), Bundle("source", ("src",)))


def lexicon_survivors(lookup: DataFrame, lemmas: DataFrame, sources: DataFrame, consistent=None, dependencies: Iterable[Dependency] = ()) -> DataFrame:
    """Survivors of ``lookup`` by ``lang`` and ``form``, with ``lemma_id`` and ``src`` as one bundle each.

    consistent: forms are compared by their consistent form (None: as written); each is rewritten once.
    """
    rows = lookup.select("row_id", "form", "lemma_id", "src", "lang", "updated_at").where(F.length("form") > 0)
    if consistent is not None:
        rows = consistent.replaced(rows, "form")
    return survivors(lexicon_records(rows, lemmas, sources), ["lang", "form"], list(BUNDLES), trust="_trust", time="updated_at", row_id="row_id", dependencies=dependencies)
