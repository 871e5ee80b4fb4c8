"""Join, radix and materialisation operators."""

from .joins import STRATEGIES, Strategy, first_per_key, join_pairs, join_summary, strategy
from .late import fetch_rows, late_materialised_join
from .radix import asymmetric_ids, histogram, max_partition, partition_by_radix, prefix_sum, two_pass_ids
from .skew import salted_join, split_join

__all__ = [
    "STRATEGIES", "Strategy", "asymmetric_ids", "fetch_rows", "first_per_key", "histogram", "join_pairs", "join_summary",
    "late_materialised_join", "max_partition", "partition_by_radix", "prefix_sum", "salted_join", "split_join", "strategy", "two_pass_ids",
]
