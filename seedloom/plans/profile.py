"""What each stage of a mapping makes, and how long a base takes, observed while it runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.anchors import anchors
from ..operators.index import SeedIndex
from ..operators.minimizers import minimizers
from ..operators.vote import covered, decided, top_records, vote_groups
from ..params import MapParams
from ..shared import written


def profiled(reads: DataFrame, index: SeedIndex, p: MapParams) -> tuple[DataFrame, dict, float]:
    """(records, rows made by stage, milliseconds per base) of mapping reads (read_id, len, seq), in one run."""
    seen = {}

    def observed(df: DataFrame, stage: str) -> DataFrame:
        seen[stage] = Observation()
        return df.observe(seen[stage], F.count(F.lit(1)).alias("rows"), *([F.sum("len").alias("bases")] if stage == "reads" else []))

    own = observed(reads.select("read_id", "len", "seq"), "reads")
    seeds = observed(minimizers(own, index.params, "read_id", ("len",)), "seeds")
    groups = observed(vote_groups(observed(anchors(seeds, index.keys), "anchors"), p), "groups")
    records = observed(decided(top_records(observed(covered(groups, p), "covered"), p), p), "records")
    began = time.perf_counter()
    done = written(records, "records")
    ms = (time.perf_counter() - began) * 1000
    got = {stage: o.get for stage, o in seen.items()}
    return done, {stage: x["rows"] for stage, x in got.items()}, ms / max(1, got["reads"]["bases"] or 0)
