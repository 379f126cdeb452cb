"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells of source, language and topic. Each margin's targets are
expected tokens of the sample: its wanted shares of the token budget, where a
name that has less gives all it has and the others of its margin give more. The
cells' tokens times one factor a name are then raked to each margin in turn,
where no cell gives more than it has, until all margins agree; a document is
drawn with its cell's share by a hash of its own. The state between rounds is
one factor a name. DataFrame operations only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .lookups import lookup
from .storage import Scratch

MARGINS = ("source", "lang", "topic")
_GRID = 64
#: Names of all margins whose factors the driver may keep between rounds.
NAMES = 1000


def topic_of(text: Column) -> Column:
    """A coarse topic from the make-up of the whole text, for tables that have none."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marks = F.length(text) - F.length(F.translate(text, "*&%$#!", ""))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n = F.length(text)
    return F.when(n == 0, "empty").when(bars * 30 > n, "tables").when(marks * 12 > n, "marks").when(capitals * 3 > n, "capitals").when(n < 400, "notes").otherwise("prose")


def token_count(text: Column) -> Column:
    """Words of a text: maximal runs without the six ASCII blanks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass(frozen=True)
class Raking:
    """Sampling probabilities that meet source, language and topic targets.

    ``targets`` gives a margin's wanted shares by name; a margin without targets
    gets shares proportional to its tokens to the power ``temper``. Names that
    hold no tokens are left out, documents of names that targets leave out are
    never drawn, and shares are scaled to one. ``fraction`` of all tokens is the
    budget, or all that the wanted names have. ``topic`` names a column of
    topics; without it they come from the make-up of the text. Targets that no
    cells can meet together stay unmet after ``rounds``: ``margins`` tells.

    Needs ``doc_id, text, lang, source``. A null lang, source or topic is the name
    ``(null)``, a null text is empty; documents without tokens are never drawn.
    Repeated rows share a fate, as do equal texts without a doc_id. No rows give
    no rows.
    """

    fraction: float = 0.5
    temper: float = 0.5
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 40
    tolerance: float = 1e-6
    seed: int = 11
    topic: str | None = None

    def cells(self, docs: DataFrame) -> DataFrame:
        """Adds the cell's names and the number of tokens."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
        return docs.withColumns({"_source": name("source"), "_lang": name("lang"), "_topic": name(f"`{self.topic}`") if self.topic else topic_of(text), "_tokens": token_count(text)})

    def _wanted(self, cells: DataFrame, margin: str) -> DataFrame:
        """``margin, name, raw``: unscaled shares of names that have tokens."""
        sums = cells.groupBy(F.col(f"_{margin}").alias("name")).agg(F.sum("tokens").alias("t"))
        given = self.targets.get(margin)
        if given is None:
            raw = sums.select("name", F.pow("t", F.lit(self.temper)).alias("raw"))
        else:
            pairs = F.explode(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))]))
            names = cells.sparkSession.range(1).select(pairs.alias("name", "raw")).where("raw > 0")
            raw = names.join(sums.select("name"), "name", "left_semi")
        return raw.select(F.lit(margin).alias("margin"), "name", "raw")

    def goals(self, cells: DataFrame, scratch: Scratch) -> DataFrame:
        """``margin, name, want, has, target`` of every wanted name: share, tokens there are, and expected tokens."""
        total = cells.agg(F.sum("tokens")).first()[0] or 0
        wanted = cells.where("tokens > 0")
        for m in self.targets:
            names = [k for k, v in self.targets[m].items() if v > 0]
            wanted = wanted.where(F.col(f"_{m}").isin(names))
        wanted = scratch.write(wanted, "wanted")
        raw = reduce(DataFrame.unionByName, [self._wanted(wanted, m) for m in MARGINS])
        has = reduce(DataFrame.unionByName, [wanted.groupBy(F.lit(m).alias("margin"), F.col(f"_{m}").alias("name")).agg(F.sum("tokens").cast("double").alias("has")) for m in MARGINS])
        sums = raw.groupBy("margin").agg(F.sum("raw").alias("all"))  # three rows
        shares = raw.join(F.broadcast(sums), "margin").select("margin", "name", (F.col("raw") / F.col("all")).alias("want"))
        table = scratch.write(shares.join(has, ["margin", "name"]), "shares")
        budget = min(self.fraction * total, float(wanted.agg(F.sum("tokens")).first()[0] or 0))
        # by margin, the scale at which min(has, scale * want) sums to the budget
        scale = {r["margin"]: (budget, float(r["most"])) for r in table.groupBy("margin").agg(F.max(F.col("has") / F.col("want")).alias("most"), F.max(budget * F.col("want") / F.col("has")).alias("over")).where("over > 1").collect()}
        for _ in range(5 if scale else 0):  # each closes the brackets by the grid's width
            at = lambda m, i: scale[m][0] + (scale[m][1] - scale[m][0]) * i / _GRID
            step = lambda i: reduce(lambda e, m: F.when(F.col("margin") == m, F.lit(at(m, i))).otherwise(e), scale, F.lit(0.0))
            got = table.groupBy("margin").agg(*[F.sum(F.least("has", F.col("want") * step(i))).alias(f"g{i}") for i in range(_GRID + 1)]).collect()
            for r in got:
                if r["margin"] in scale:
                    k = next((i for i in range(1, _GRID + 1) if r[f"g{i}"] >= budget), _GRID)
                    scale[r["margin"]] = at(r["margin"], k - 1), at(r["margin"], k)
        by = reduce(lambda e, m: F.when(F.col("margin") == m, F.lit(scale[m][1])).otherwise(e), scale, F.lit(float(budget)))
        return scratch.write(table.withColumn("target", F.least("has", F.col("want") * by)), "goals")

    def _attached(self, cells: DataFrame, now: dict[str, DataFrame | dict[str, float]]) -> DataFrame:
        """Cells with their names' factors ``f_source, f_lang, f_topic``: from a literal map, or joined."""
        for m, factors in now.items():
            if isinstance(factors, dict):
                known = F.from_json(F.lit(json.dumps(factors)), "map<string,double>")
                cells = cells.withColumn(f"f_{m}", known[F.col(f"_{m}")])
            else:
                cells = cells.join(factors, f"_{m}")
        return cells

    def rake(self, goals: DataFrame, scratch: Scratch) -> dict[str, DataFrame | dict[str, float]]:
        """By margin a factor of each name: a cell gives its tokens times its names' factors, or all it has.

        Each step is one aggregation of the cells. Up to ``NAMES`` names, their
        factors are kept by the driver; beyond, as a written table a margin.
        """
        cells = scratch.read("wanted")
        kept = goals.count() <= NAMES
        first = lambda m: self.fraction if m == MARGINS[0] else 1.0
        goal = {m: goals.where(F.col("margin") == m).select(F.col("name").alias(f"_{m}"), "target") for m in MARGINS}
        if kept:
            target = {m: {r[0]: r[1] for r in goal[m].collect()} for m in MARGINS}
            now = {m: dict.fromkeys(target[m], first(m)) for m in MARGINS}
        else:
            now = {m: goal[m].select(f"_{m}", F.lit(first(m)).alias(f"f_{m}")) for m in MARGINS}
        last, gives = None, F.col("tokens") * F.col("f_source") * F.col("f_lang") * F.col("f_topic")
        full = gives >= F.col("tokens")
        for k in range(self.rounds):
            worst = 0.0
            for m in MARGINS:
                sums = self._attached(cells, now).groupBy(f"_{m}").agg(F.sum(F.when(full, F.col("tokens").cast("double")).otherwise(0.0)).alias("stuck"), F.sum(F.when(full, 0.0).otherwise(gives)).alias("free"), F.first(f"f_{m}").alias("old"))
                if kept:
                    for name, stuck, free, old in sums.collect():  # NAMES rows at most
                        want = target[m][name]
                        now[m][name] = old * ((want - stuck) / free if want > stuck and free > 0 else want / (stuck + free))
                        worst = max(worst, abs((stuck + free) / want - 1))
                    continue
                step = F.when((F.col("target") > F.col("stuck")) & (F.col("free") > 0), (F.col("target") - F.col("stuck")) / F.col("free")).otherwise(F.col("target") / (F.col("stuck") + F.col("free")))
                seen = Observation()
                off = F.abs((F.col("stuck") + F.col("free")) / F.col("target") - 1)
                new = sums.join(goal[m], f"_{m}").select(f"_{m}", (F.col("old") * step).alias(f"f_{m}"), off.alias("off")).observe(seen, F.max("off").alias("worst"))
                now[m] = scratch.write(new, f"factor-{m}-{k}").drop("off")
                worst = max(worst, seen.get["worst"] or 0.0)
                if k:
                    scratch.drop(f"factor-{m}-{k - 1}")
            if worst <= self.tolerance or (last is not None and k > 10 and worst > last * 0.999):
                break  # met, or targets that no cells can meet together
            last = worst
        return now

    def chances(self, cells: DataFrame, scratch: Scratch) -> DataFrame:
        """``_source, _lang, _topic, tokens, p`` of the wanted cells; ``cells`` is a stored table."""
        factors = self.rake(self.goals(cells, scratch), scratch)
        out = self._attached(scratch.read("wanted"), factors)
        p = F.least(F.lit(1.0), F.col("f_source") * F.col("f_lang") * F.col("f_topic"))
        return scratch.write(out.select("_source", "_lang", "_topic", "tokens", p.alias("p")), "chances")

    def margins(self, scratch: Scratch) -> DataFrame:
        """After ``draw`` with this scratch: ``margin, name, want, target, expected`` tokens of every wanted name."""
        cells = scratch.read("chances")
        got = reduce(DataFrame.unionByName, [cells.groupBy(F.lit(m).alias("margin"), F.col(f"_{m}").alias("name")).agg(F.sum(F.col("tokens") * F.col("p")).alias("expected")) for m in MARGINS])
        return scratch.read("goals").join(got, ["margin", "name"]).select("margin", "name", "want", "target", "expected")

    def draw(self, docs: DataFrame, scratch: Scratch | None = None, columns: list[str] | None = None) -> DataFrame:
        """All rows with ``columns`` (all of them if not given), ``tokens``, ``topic``, ``probability`` and ``sampled``."""
        scratch = scratch or Scratch(docs.sparkSession, "raking")
        chance = F.pmod(F.xxhash64(F.lit(self.seed), F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.col("text").cast("string"))), F.lit(1 << 53)) / float(1 << 53)
        kept = [c for c in columns or docs.columns if c not in ("tokens", "topic", "probability", "sampled")]
        own = [f"_k{i}" for i in range(len(kept))]  # out of the way of names used here
        placed = self.cells(docs).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(kept, own, strict=True)], "_source", "_lang", "_topic", "_tokens", chance.alias("_chance"))
        placed = scratch.write(placed, "placed")
        cells = scratch.write(placed.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")), "cells")
        p = self.chances(cells, scratch)
        scratch.keep("placed", "chances", "goals")
        drawn = lookup(placed, p.select("_source", "_lang", "_topic", "p"), ["_source", "_lang", "_topic"], 120, "left").withColumn("_p", F.when(F.col("_tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0))
        return drawn.select(*[F.col(k).alias(c) for c, k in zip(kept, own, strict=True)], F.col("_tokens").alias("tokens"), F.col("_topic").alias("topic"), F.col("_p").alias("probability"), (F.col("_chance") < F.col("_p")).alias("sampled"))
