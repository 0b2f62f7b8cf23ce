"""Claims -> labelled single-claim assets -> telemetry window -> faulted assets.

Order matters and follows the reference job: candidate filter, then the
disposition join, then the one-claim-per-asset rule; the fault-code test is
judged on raw window rows before any cleaning of feature values.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.functions import fault_code_match, group_match

# A claims side above this many rows, or above this many bytes of data, is not
# broadcast to the telemetry scan; the join then shuffles both sides by asset and day.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 << 20


def candidate_filter(claims: DataFrame, candidates) -> DataFrame:
    """Keep claims whose failed part is one of the candidates (pushed to the scan)."""
    candidates = list(candidates)
    if not candidates:
        raise ValueError("candidate component list is empty")
    return claims.filter(F.col(S.PART).isin(candidates))


def label_claims(claims: DataFrame, targets) -> DataFrame:
    """label = 1 when the failed part is a target component, else 0."""
    targets = list(targets)
    if not targets:
        raise ValueError("target component list is empty")
    return claims.withColumn(S.LABEL, F.when(F.col(S.PART).isin(targets), 1).otherwise(0))


def project_claims(claims: DataFrame) -> DataFrame:
    return claims.select(S.CLAIM_ID, S.ASSET, S.PART, S.FAILURE_DATE, S.LABEL)


def join_dispositions(claims: DataFrame, dispositions: DataFrame) -> DataFrame:
    """claims LEFT JOIN dispositions on the claim id (keeps the flag column).

    A claim with two dispositions appears twice.
    """
    return claims.join(dispositions, on=S.CLAIM_ID, how="left")


def exclude_no_fault(joined: DataFrame) -> DataFrame:
    """Drop claims flagged 'Y' (no trouble found).

    ``flag != 'Y'`` is null for a missing or null flag, so those claims go too;
    with the left join above this makes the pair an inner join, which Catalyst
    plans as such.
    """
    return joined.filter(F.col(S.FLAG) != "Y").drop(S.FLAG)


def claims_per_asset(claims: DataFrame) -> DataFrame:
    """Non-null claim rows per asset (null asset keys count 0)."""
    return claims.groupBy(S.ASSET).agg(F.count(S.ASSET).alias("count"))


def single_claim_assets(claims: DataFrame) -> DataFrame:
    """Keep claim rows of assets that have exactly one row left.

    One aggregation per asset carries the row's columns with ``first``, and
    groups of size one keep them (there ``first`` has a single row to pick).
    That is one pass over the claim pipeline (a count + semi join would run
    it twice) and one shuffle of partial aggregates: a hot asset costs one
    row per map task.  A null asset has count 0 and never survives.
    """
    others = [c for c in claims.columns if c != S.ASSET]
    agg = claims.groupBy(S.ASSET).agg(F.count(S.ASSET).alias("_n"),
                                      *[F.first(c).alias(c) for c in others])
    return agg.filter(F.col("_n") == 1).select(*claims.columns)


def labelled_claims(claims: DataFrame, dispositions: DataFrame, candidates, targets) -> DataFrame:
    """Candidate filter -> label -> project -> disposition join -> drop 'Y'."""
    c = project_claims(label_claims(candidate_filter(claims, candidates), targets))
    return exclude_no_fault(join_dispositions(c, dispositions))


def claim_cohort(claims: DataFrame, dispositions: DataFrame, candidates, targets) -> DataFrame:
    """All claim-side steps: one labelled claim row per kept asset."""
    return single_claim_assets(labelled_claims(claims, dispositions, candidates, targets))


def group_filter(telemetry: DataFrame, platforms, emissions) -> DataFrame:
    """Keep telemetry rows whose packed group has the platform and emission tokens."""
    if not platforms and not emissions:
        return telemetry
    from faultlens.sources.layout import EMISSION, PLATFORM, has_layout
    if has_layout(telemetry):
        # Same tokens, stored as partition columns: the filter prunes directories.
        return telemetry.filter(F.col(PLATFORM).isin(list(platforms)) &
                                F.col(EMISSION).isin(list(emissions)))
    return telemetry.filter(group_match(S.GROUP, platforms, emissions))


@dataclass(frozen=True)
class ClaimStats:
    rows: int
    first_failure: dt.date | None
    last_failure: dt.date | None
    data_bytes: int = 0          # measured: string lengths + 8 bytes per other value

    def broadcastable(self, max_rows: int | None, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
        return max_rows is not None and self.rows <= max_rows and self.data_bytes <= max_bytes


def claim_stats(claims: DataFrame) -> ClaimStats:
    """One small aggregate over the claim side: size and failure-date range.

    The result is one row whatever the data size; it decides the join
    strategy and gives literal time bounds for the telemetry scan.
    """
    def width(f):
        t = f.dataType.simpleString()
        if t == "string":
            return F.coalesce(F.length(F.col(f.name)), F.lit(0))
        if t == "array<string>":
            return F.coalesce(F.length(F.concat_ws(",", F.col(f.name))), F.lit(0)) + 16
        if t.startswith("array"):
            return F.coalesce(F.size(F.col(f.name)), F.lit(0)) * 8 + 16
        return F.lit(8)
    size = sum(width(f) for f in claims.schema.fields)
    r = claims.agg(F.count(F.lit(1)).alias("n"),
                   F.min(F.to_date(S.FAILURE_DATE)).alias("lo"),
                   F.max(F.to_date(S.FAILURE_DATE)).alias("hi"),
                   F.sum(size).alias("b")).first()
    return ClaimStats(int(r["n"]), r["lo"], r["hi"], int(r["b"] or 0))


def _time_bounds(telemetry: DataFrame, stats: ClaimStats, window_days: int):
    """Literal bounds on the occurrence time implied by the window test.

    failure >= occurrence and datediff(failure, occurrence) <= d imply
    date(min failure) - d <= occurrence <= max failure (end of that day when
    the failure value is a timestamp).  Literal bounds reach the Parquet
    reader, which skips row groups and partitions outside the range.
    """
    if stats.first_failure is None:
        return F.lit(False)
    tt = telemetry.schema[S.OCCURRENCE].dataType.simpleString()
    lo = stats.first_failure - dt.timedelta(days=window_days)
    hi = stats.last_failure + dt.timedelta(days=1)
    occ = F.col(S.OCCURRENCE)
    cond = ((occ >= F.lit(lo.isoformat()).cast(tt)) &
            (occ < F.lit(hi.isoformat()).cast(tt)))
    from faultlens.sources.layout import DAY
    if DAY in telemetry.columns:
        # Day-partitioned telemetry: the same bounds as partition filters.
        day = F.col(DAY)
        cond = cond & (day >= F.lit(lo.isoformat()).cast("date")) & \
            (day < F.lit(hi.isoformat()).cast("date"))
    return cond


def telemetry_window_join(claims: DataFrame, telemetry: DataFrame, window_days: int = 7,
                          broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS,
                          stats: ClaimStats | None = None) -> DataFrame:
    """Claims joined to the telemetry of their asset in the window before failure.

    Window test (kept exactly): ``failure >= occurrence`` and
    ``datediff(failure, occurrence) <= window_days`` (calendar days).
    """
    stats = stats or claim_stats(claims)
    tel = telemetry.filter(_time_bounds(telemetry, stats, window_days))
    return window_join(claims, tel, F.lit(window_days), window_days, stats, broadcast_rows)


def window_join(claims: DataFrame, tel: DataFrame, window, most: int, stats: ClaimStats,
                broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``window`` is the claim's window in days (a column), at most ``most``.

    The claim side is broadcast only when its measured row count is at most ``broadcast_rows`` and its
    measured data size at most ``DEFAULT_BROADCAST_BYTES`` (a proven bound); the telemetry is then never
    shuffled and the window is a residual predicate of the equi-join on the asset.

    Above that it is a range join by buckets of days: a claim is spread over the buckets of its window, readings
    outside any of these are dropped by a Bloom filter of (asset, bucket) before they are shuffled, and both
    sides meet on (asset, bucket), so a hot asset is split by time (and a hot bucket by AQE).
    """
    fail, occ = F.col(S.FAILURE_DATE), F.col(S.OCCURRENCE)
    inside = (fail >= occ) & (F.datediff(fail, occ) <= window)
    if stats.broadcastable(broadcast_rows):
        return F.broadcast(claims).join(tel, on=S.ASSET, how="inner").filter(inside)
    width = max(1, (most + 1) // BUCKETS_PER_WINDOW)
    bucket = lambda day: F.floor(F.unix_date(day) / width).cast("int")      # noqa: E731
    day = F.to_date(fail)
    side = claims.withColumn("_bucket", F.explode(F.sequence(bucket(F.date_sub(day, window)), bucket(day))))
    tel = tel.withColumn("_bucket", bucket(F.to_date(occ)))
    if claims.schema[S.ASSET].dataType == tel.schema[S.ASSET].dataType:      # else equal keys may hash apart
        tel = bloom_filtered(tel, side, [S.ASSET, "_bucket"], stats.rows * (BUCKETS_PER_WINDOW + 2))
    return side.join(tel, on=[S.ASSET, "_bucket"], how="inner").filter(inside).drop("_bucket")


# Buckets of days that a claim's window is cut into, about.
BUCKETS_PER_WINDOW = 8
# Bloom filter: bits per key, bits set per key, and words of 64 bits at most (they are broadcast).
BLOOM_BITS, BLOOM_HASHES, BLOOM_WORDS = 16, 5, 1 << 21


def bloom_filtered(rows: DataFrame, keys: DataFrame, columns: list[str], n_keys: int) -> DataFrame:
    """``rows`` without most of those whose ``columns`` equal none of ``keys`` (all that do stay).

    A blocked Bloom filter as a table: a key sets its bits in one 64-bit word; words are OR-ed by a
    partial aggregate and broadcast, at most ``BLOOM_WORDS`` rows whatever the number of keys (beyond
    ``n_keys`` x ``BLOOM_BITS`` bits it drops less).  Everything stays in the JVM.
    """
    words = min(BLOOM_WORDS, max(1, -(-n_keys * BLOOM_BITS // 64)))

    def probe(df: DataFrame) -> DataFrame:
        h = F.xxhash64(*columns)
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int"))
                for i in range(1, BLOOM_HASHES + 1)]
        mask = bits[0]
        for x in bits[1:]:
            mask = mask.bitwiseOR(x)
        return df.withColumn("_word", F.pmod(F.shiftrightunsigned(h, 36), F.lit(words))).withColumn("_mask", mask)

    table = probe(keys.select(*columns)).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    hit = probe(rows).join(F.broadcast(table), "_word")
    return hit.filter(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select(*rows.columns)


def asset_key_set(rows: DataFrame, codes) -> DataFrame:
    """Distinct assets with at least one row carrying one of the fault codes."""
    return rows.filter(fault_code_match(codes, S.FAULTS)).select(S.ASSET).distinct()


def faulted_assets(window_rows: DataFrame, codes, broadcast_keys: bool = False) -> DataFrame:
    """All window rows of every asset that has >= 1 row with a chosen fault code.

    The key set is a subset of the claim cohort's assets, so when the claim
    side was small enough to broadcast, so is the key set.
    """
    keys = asset_key_set(window_rows, codes)
    if broadcast_keys:
        keys = F.broadcast(keys)
    return window_rows.join(keys, on=S.ASSET, how="left_semi")
