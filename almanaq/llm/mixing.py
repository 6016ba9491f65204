"""Mixing sources to target weights: token weights raked to marginals, documents sampled by calibrated probabilities.

Documents are summed to cells (source, language, topic) before anything else; raking works on cells only. All steps are
DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.sources.tables import discard

from .common import materialise

DIMS = ("source", "lang", "topic")
NONE = "(none)"

#: Share of a value in the mix is proportional to its tokens to this power: 1 keeps the corpus, 0 makes all equal.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}

#: Error of a marginal up to which it counts as reached.
REACHED = 1e-5


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, the token measure of the mix."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """Coarse topic of a text by what stands in it; the first rule that holds."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit("License")) | F.contains(t, F.lit("license")), "legal")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(t.rlike("[0-9]"), "figures").otherwise("prose"))


def total_tokens(cells: DataFrame) -> int:
    return cells.agg(F.sum("tokens")).first()[0] or 0


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = 1e-6) -> tuple[DataFrame, bool]:
    """Iterative proportional fitting: ``cells`` with ``weight`` fitted to the marginal ``target`` of every dimension, and
    whether it has them.

    ``targets[d]`` has ``d, target``; targets of one dimension sum to 1, a value that is not listed has target 0. One
    round fits every dimension once. Rounds go on, however many, until no marginal is off by more than ``tolerance``, or
    until it is proved that no weights of these cells can have the targets: the logarithms ``u`` of a round's factors,
    added up per cell, are all smaller than their mean under the targets, where under any weights that have the targets
    the two means are the same and a mean can't exceed the largest. A value without tokens keeps weight 0.
    """
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(total_tokens(cells), 1))))
    last = None
    while True:
        worst, toward, ahead = [], F.lit(0.0), F.lit(0.0)
        for d, target in targets.items():
            wanted = F.coalesce(F.col("target"), F.lit(0.0))
            sums = cells.groupBy(d).agg(F.sum("weight").alias("__sum")).join(target, d, "left")
            factor = sums.select(d, F.when(F.col("__sum") > 0, wanted / F.col("__sum")).otherwise(F.lit(1.0)).alias(f"__f_{d}"))
            cells = cells.join(factor, d).withColumn("weight", F.col("weight") * F.col(f"__f_{d}"))
            cells = cells.withColumn(f"__w_{d}", F.col("weight"))  # now the marginals of d are its targets
            log = F.when(F.col(f"__f_{d}") > 0, F.log(f"__f_{d}"))
            worst.append(F.max(F.abs(F.col(f"__f_{d}") - 1)))
            toward = toward + F.coalesce(F.col(f"__w_{d}") * log, F.lit(0.0))
            ahead = ahead + log
        fitted = materialise(cells)
        row = fitted.agg(
            (F.greatest(*worst) if len(worst) > 1 else worst[0]).alias("off"), F.sum(toward).alias("mean"),
            F.max(F.when(F.col("tokens") > 0, ahead)).alias("most"), F.sum("weight").alias("whole")).first()
        cells = fitted.drop(*[f"__{c}_{d}" for c in "fw" for d in targets])
        if last is not None:
            discard(last)
        last = fitted
        off, mean, most = row["off"] or 0.0, row["mean"] or 0.0, row["most"]
        if off <= tolerance or not row["whole"]:
            return cells, off <= tolerance
        if most is None or mean > most + 1e-12 * max(1.0, abs(most)):
            return cells, False


def reached(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """``dim, value, target, reached`` of every value in ``cells`` or ``targets``: the share asked and the share it has."""
    whole = F.broadcast(cells.agg(F.sum("weight").alias("whole")))
    out = None
    for d, target in targets.items():
        sums = cells.groupBy(d).agg(F.sum("weight").alias("has")).crossJoin(whole)
        share = F.when(F.col("whole") > 0, F.col("has") / F.col("whole"))
        part = sums.join(target, d, "full").select(
            F.lit(d).alias("dim"), F.col(d).alias("value"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce(share, F.lit(0.0)).alias("reached"))
        out = part if out is None else out.union(part)
    return out


def refuse_missed(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float) -> None:
    """Raises ``ArithmeticError`` with the marginals asked and reached when ``cells`` don't have the ``targets``."""
    missed = reached(cells, targets).where(F.abs(F.col("reached") - F.col("target")) > tolerance)
    n = missed.count()
    if n:
        worst = missed.orderBy(F.abs(F.col("reached") - F.col("target")).desc(), "dim", "value").limit(10).collect()
        listed = "; ".join(f"{r['dim']} {r['value']}: asked {r['target']:.6f}, reached {r['reached']:.6f}" for r in worst)
        raise ArithmeticError(f"the targets can't be met together, {n} marginals are off ({listed})")


def tempered_targets(cells: DataFrame, temper: Mapping[str, float]) -> dict[str, DataFrame]:
    """Target share of every value: its tokens to a power, as a share of all."""
    out = {}
    for d, power in temper.items():
        raised = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(power))).alias("raised"))
        whole = raised.agg(F.sum("raised").alias("whole"))
        out[d] = materialise(raised.crossJoin(F.broadcast(whole)).select(d, F.when(F.col("whole") > 0, F.col("raised") / F.col("whole")).otherwise(0.0).alias("target")))
    return out


def tempered_cells(cells: DataFrame, temper: Mapping[str, float]) -> DataFrame:
    """``cells`` with ``weight``, tempered jointly: tokens times, for each dimension, the value's tokens to the power less 1.

    Where the dimensions are independent the marginals are those of ``tempered_targets``. Where they are tied to each
    other (sources of one language) these marginals contradict each other, and the ones of this mix stand in for them.
    """
    weight = F.col("tokens").cast("double")
    for d, power in temper.items():
        factor = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("__sum")).select(
            d, F.when(F.col("__sum") > 0, F.pow("__sum", F.lit(float(power) - 1))).otherwise(F.lit(0.0)).alias(f"__f_{d}"))
        cells = cells.join(factor, d)
        weight = weight * F.col(f"__f_{d}")
    return cells.withColumn("weight", weight).drop(*[f"__f_{d}" for d in temper])


def rounded(share: Column) -> Column:
    """A number of 0..1 to six digits, counted from its first one: small probabilities keep their precision."""
    unit = F.pow(F.lit(10.0), F.ceil(F.log10(share)))
    return F.when(share > 0, F.round(share / unit, 6) * unit).otherwise(share)


def uniform(id_: Column, seed: int) -> Column:
    """Number in [0, 1) from an id, equal on every machine and in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix_weights(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", temper: Mapping[str, float] = TEMPER, seed: int = 17,
        targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, kept, targets`` per row of ``docs``.

    The probability of a cell is its raked weight per token, to six digits, scaled so that the best wanted cell has 1:
    then the expected mix has the target marginals. The column ``targets`` tells which: ``given`` ones; else
    ``tempered``, the tempered share of every value, unless it is proved that no mix of these cells has them (sources of
    one language, say); then ``joint``, the marginals of ``tempered_cells``, which always belong to a mix. Given targets that raking doesn't reach raise ``ArithmeticError``
    with the marginals asked and reached; a value they don't list gets probability 0.

    Null source or language is the value "(none)"; a missing column too. Documents without tokens weigh nothing and get
    their cell's probability (1 when the cell has no tokens). Rows that repeat an id are decided alike; extra columns are
    not read.
    """
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), *_cell(docs, text_col), token_count(F.col(text_col)).alias("n_tokens")))
    chance, law = _chances(rows, temper, targets)
    return rows.join(chance, list(DIMS)).select(
        "doc_id", *DIMS, "n_tokens", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("kept"),
        F.lit(law).alias("targets"))


def _cell(docs: DataFrame, text_col: str, prefix: str = "") -> list[Column]:
    def named(c: str) -> Column:
        return (F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in docs.columns else F.lit(NONE)).alias(prefix + c)

    return [named("source"), named("lang"), topic(F.col(text_col)).alias(f"{prefix}topic")]


def _chances(rows: DataFrame, temper: Mapping[str, float], targets: Mapping[str, DataFrame] | None) -> tuple[DataFrame, str]:
    """Probability of every cell of ``rows (source, lang, topic, n_tokens)``, and which targets the mix has."""
    cells = materialise(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    if targets:
        law, (fitted, _) = "given", rake(cells, targets)
        if total_tokens(cells):
            refuse_missed(fitted, targets, REACHED)
    else:
        law, (fitted, has) = "tempered", rake(cells, tempered_targets(cells, temper))
        if not has and total_tokens(cells):
            law, fitted = "joint", tempered_cells(cells, temper)  # has its own marginals, raking would leave it as it is
    rate = materialise(fitted.select(*DIMS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).alias("rate")))
    best = rate.agg(F.max("rate").alias("best"))
    chance = rate.crossJoin(F.broadcast(best)).select(*DIMS, F.coalesce(rounded(F.col("rate") / F.col("best")), F.lit(1.0)).alias("probability"))
    return materialise(chance), law


def sample_mix(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", temper: Mapping[str, float] = TEMPER, seed: int = 17,
        targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix_weights`` keeps, with all their columns.

    The cells' probabilities, a row per cell, are joined to the documents; while they are few Spark sends them to the
    documents, which then aren't shuffled.
    """
    chance, _ = _chances(docs.select(*_cell(docs, text_col), token_count(F.col(text_col)).alias("n_tokens")), temper, targets)
    keyed = docs.select("*", *_cell(docs, text_col, "__"))
    named = chance.select(*[F.col(d).alias(f"__of_{d}") for d in DIMS], F.col("probability").alias("__probability"))
    joined = keyed.join(named, [F.col(f"__{d}") == F.col(f"__of_{d}") for d in DIMS])
    return joined.where(uniform(F.col(id_col), seed) < F.col("__probability")).select(*[F.col(f"`{c}`") for c in docs.columns])
