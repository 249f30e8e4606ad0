"""Parameters of indexing and mapping, and presets by read technology."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class IndexParams:
    """w: k-mers in a window; k: bases in a seed; map_size: bits of a bucket id; max_occ: most keys of a seed that stays; ties: which of equal minima wins; dialect: which letters are ambiguous."""

    w: int = 10
    k: int = 15
    map_size: int = 30
    max_occ: int = 500
    ties: str = "left"
    dialect: str = "host"

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 25 or not 1 <= self.w <= 256:
            raise ValueError("k must be 1 to 25 and w 1 to 256")
        if self.ties not in ("left", "right") or self.dialect not in ("host", "device"):
            raise ValueError("ties are left or right, dialects host or device")

    @property
    def bucket_bits(self) -> int:
        return min(self.map_size, 2 * self.k)


@dataclass(frozen=True)
class MapParams:
    """top: records kept for a read; distance: reach of a vote; coverage, fraction: 32-bit thresholds; reject_ties: a read whose best two records are level is unmapped; compat_origin: votes start from a group at the origin."""

    top: int = 6
    distance: int = 700
    fraction: float = 0.4
    coverage: float = 0.1
    reject_ties: bool = True
    compat_origin: bool = True


PRESETS = {
    "default": (IndexParams(), MapParams()),
    "ont": (IndexParams(10, 15, 30, 10), MapParams(distance=950)),
    "hifi": (IndexParams(19, 19, 30, 1), MapParams(distance=5000)),
    "illumina": (IndexParams(11, 21, 30, 50), MapParams(distance=10, coverage=0.0, reject_ties=False)),
}


def preset(name: str, **changes) -> tuple[IndexParams, MapParams]:
    """A preset, with changes to either part."""
    index, mapping = PRESETS[name]
    own = {k: v for k, v in changes.items() if k in IndexParams.__dataclass_fields__}
    return replace(index, **own), replace(mapping, **{k: v for k, v in changes.items() if k not in own})
