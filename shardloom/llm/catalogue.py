"""Queries of this subpackage, and SQL where it can express them.

Beside the ten operators' queries stand three that show what SQL can express of results it cannot.
"""

from . import decontaminate, lm, neardup, packing, quality_rules, sharding, warc
from .decontaminate import op2_decontaminate
from .langid import op4_language
from .lm import lm_base, op5_language_model
from .neardup import op10_near_duplicates
from .packing import op1_packing, packing_law
from .quality_model import op6_quality_model
from .quality_rules import op3_quality_rules
from .sharding import op9_sharding, sharding_sizes
from .toxicity import op7_toxicity
from .warc import op8_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_language": op4_language,
    "op5_language_model": op5_language_model,
    "op6_quality_model": op6_quality_model,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_near_duplicates": op10_near_duplicates,
    "packing_law": packing_law,
    "lm_base": lm_base,
    "sharding_sizes": sharding_sizes,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op10_near_duplicates": neardup.ORACLE_SQL,
    "packing_law": packing.LAW_SQL,
    "lm_base": lm.BASE_SQL,
    "sharding_sizes": sharding.SIZES_SQL,
}
