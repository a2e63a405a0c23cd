from .gaps import replenishments
from .integrity import (
    IntegrityError, assert_integrity, check_fk, check_not_null, check_unique, integrity_report,
    not_null_rule, unique_rule,
)
from .numbering import numbered
from .pivots import pivot_fixed, pivot_values
from .regions import with_region_name, with_regions
from .trailing import trailing_months
from .upsert import insert_if_absent

__all__ = [
    "IntegrityError", "assert_integrity", "check_fk", "check_not_null", "check_unique",
    "insert_if_absent", "integrity_report", "not_null_rule", "numbered",
    "pivot_fixed", "pivot_values", "replenishments", "trailing_months",
    "unique_rule", "with_region_name", "with_regions",
]
