"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from importlib import import_module

#: module, query, and whether the module has SQL for it.
REGISTERED = (
    ("sharding", "op1_sharding", False),
    ("pii", "op2_pii", False),
    ("decontaminate", "op3_decontamination", True),
    ("pitman_yor", "op4_pitman_yor", False),
    ("toolcalls", "op5_tool_calls", True),
    ("jaccard_join", "op6_jaccard_join", False),
    ("mixing", "op7_source_mixing", True),
    ("langid", "op8_language_id", False),
    ("simhash", "op9_simhash", False),
    ("toxicity", "op10_toxicity", False),
    ("licences", "op11_licences", True),
    ("repair", "op12_conversation_repair", True),
    ("fill_in_middle", "op13_fill_in_middle", True),
)


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name, _ in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{module}").SQL for module, name, has in REGISTERED if has}
