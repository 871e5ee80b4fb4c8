"""Column functions: keys, checksums, predicates."""

from .scalar import brand_number, descending_places, is_promo, joined_by, log2_floor, next_pow_2, radix_id, text_between
from .checksum import wrap64, wrap64_add, wrap64_sum

__all__ = ["brand_number", "descending_places", "is_promo", "joined_by", "log2_floor", "next_pow_2", "radix_id", "text_between", "wrap64", "wrap64_add", "wrap64_sum"]
