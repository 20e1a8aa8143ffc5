"""Queries of this package by name, with SQL oracles where SQL can express them."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .fingerprints import op3_fingerprints
from .langid import op6_langid
from .licenses import op9_licenses
from .minhash import op8_minhash
from .oracles import OP2_SQL, OP8_SQL, OP10_SQL
from .packing import op5_packing
from .quality import op1_quality
from .secrets import op4_secrets
from .substrings import op2_substrings
from .urlrules import OP7_SQL, op7_urlrules

QUERIES: dict = {
    "op1_quality": op1_quality,
    "op2_substrings": op2_substrings,
    "op3_fingerprints": op3_fingerprints,
    "op4_secrets": op4_secrets,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_urlrules": op7_urlrules,
    "op8_minhash": op8_minhash,
    "op9_licenses": op9_licenses,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES: dict = {"op2_substrings": OP2_SQL, "op7_urlrules": OP7_SQL, "op8_minhash": OP8_SQL, "op10_decontaminate": OP10_SQL}
