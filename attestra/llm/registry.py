"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op6_decontamination
from .fingerprint import op1_fingerprint
from .neardup import op7_neardup
from .packing import op4_packing
from .pii import op10_pii
from .secrets import op5_secrets
from .sessions import ORACLE as SESSIONS_ORACLE
from .sessions import op12_sessions
from .simhash import op13_simhash
from .substrings import op3_substrings
from .toxicity import op9_toxicity
from .urlfilter import op2_urlfilter
from .vectorcodes import ORACLE as VECTORCODES_ORACLE
from .vectorcodes import op11_vectorcodes
from .warc import ORACLE as WARC_ORACLE
from .warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_urlfilter": op2_urlfilter,
    "op3_substrings": op3_substrings,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_neardup": op7_neardup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_vectorcodes": op11_vectorcodes,
    "op12_sessions": op12_sessions,
    "op13_simhash": op13_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": WARC_ORACLE,
    "op11_vectorcodes": VECTORCODES_ORACLE,
    "op12_sessions": SESSIONS_ORACLE,
}
