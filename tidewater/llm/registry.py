"""Queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.decontaminate import OP1_SQL, op1_decontamination
from tidewater.llm.fingerprint import op12_fingerprints
from tidewater.llm.infill import OP11_SQL, op11_fill_in_middle
from tidewater.llm.langid import op2_language_id
from tidewater.llm.neardups import OP3_SQL, op3_near_duplicates
from tidewater.llm.neighbours import op6_nearest_neighbours
from tidewater.llm.packing import op4_best_fit_packing
from tidewater.llm.pagetext import op9_main_text
from tidewater.llm.repeats import OP10_SQL, op10_repeated_strings
from tidewater.llm.secrets import OP7_BASE_SQL, op7_base_spans, op7_secret_scan
from tidewater.llm.tokenfiles import op5_token_files
from tidewater.llm.turntrie import OP13_SQL, op13_prefix_tree
from tidewater.llm.warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_files": op5_token_files,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc": op8_warc,
    "op9_main_text": op9_main_text,
    "op10_repeated_strings": op10_repeated_strings,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_fingerprints": op12_fingerprints,
    "op13_prefix_tree": op13_prefix_tree,
    "op7_base_spans": op7_base_spans,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op8_warc": OP8_SQL,
    "op10_repeated_strings": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_prefix_tree": OP13_SQL,
    "op7_base_spans": OP7_BASE_SQL,
}
