"""Registered queries of this package: name -> (query, SQL or None)."""
from importlib import import_module

#: Query name -> module that holds it.
QUERIES = {
    "op1_neighbours": "neighbours",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_packing": "packing",
    "op4_cotraining": "cotraining",
    "op5_vector_dedup": "vector_dedup",
    "op6_licences": "licences",
    "op7_simhash": "simhash",
    "op8_toxicity": "toxicity",
    "op9_chat": "chat",
    "op10_mixing": "mixing",
    "op11_runs": "runs",
    "op12_codes": "codes",
    "op13_pieces": "pieces",
}


def entries() -> dict:
    out = {}
    for name, module in QUERIES.items():
        out[name] = (getattr(import_module(f".{module}", __package__), name), None)
    return out
