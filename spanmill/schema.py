"""Table schemas of the engine, as DDL strings."""

from __future__ import annotations

SPAN = "struct<begin:int,end:int>"
TOKENS = "corpus string, doc_id string, sent_id int, tok_idx int, in_sent_idx int, token string, pos string, ner string, speaker string, parse_bit string, head int, deprel string, raw_cols array<string>"
SENTENCES = f"corpus string, doc_id string, sent_id int, span {SPAN}, parse string"
MENTIONS = (
    f"corpus string, doc_id string, mention_idx int, span {SPAN}, sent_id int, tokens array<string>, pos array<string>, ner array<string>, head array<string>, head_span {SPAN}, head_index int, "
    "type string, fine_type string, citation_form string, number string, gender string, semantic_class string, grammatical_function string, governor string, deprel string, ancestry string, speaker string, "
    "is_apposition boolean, annotated_set_id int, set_id int, first_in_gold_entity boolean, head_as_lowercase_string string, tokens_as_lowercase_string string"
)
ARCS = "doc_id string, ana_idx int, ante_idx int, rank int, feats array<int>, num_feats array<struct<idx:int,val:float>>, costs array<int>, consistent boolean"
DECISIONS = "doc_id string, ana_idx int, ante_idx int, label string, score double"
CLUSTERS = "doc_id string, mention_idx int, entity_id int"
ERRORS = f"system string, kind string, category string, doc_id string, ana {SPAN}, ante {SPAN}"
MODEL = "label string, idx int, weight double"
PRIORS = "label string, prior double"
