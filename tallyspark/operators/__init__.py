"""Operators: DataFrame -> DataFrame functions (see README for the map)."""

from tallyspark.operators.credentials import (connection_status, decrypt_cols, encrypt_cols, from_token_record,
                                             latest_by, to_token_record)
from tallyspark.operators.ids import assign_ids, next_id
from tallyspark.operators.mapping import apply_mappings, apply_mappings_into_table
from tallyspark.operators.matching import match_candidates, match_candidates_nested, match_routed
from tallyspark.operators.normalize import (account_row, company_profile, customer_search_row, mapping_action,
                                           mapping_row, normalize_party, payment_method_row, result_label,
                                           result_meta, service_item_row, tax_code_row)
from tallyspark.operators.payloads import attach_version, build_item_payload
from tallyspark.operators.search import search, term_ok, term_ok_col
from tallyspark.operators.settings import defaults_coverage, fan_out_tax_rate, save_defaults, sync_markers
from tallyspark.operators.upsert import (auto_touch, check_inserts, collapse_batch, combine_batches, dedupe_last,
                                         insert_ignore, prepare_batch, sync_stats, upsert, upsert_entities)
from tallyspark.operators.validate import (audit_domain, audit_length, audit_not_null, audit_primary_key,
                                           audit_reference, audit_table, audit_unique, default_fill, require,
                                           split_required)

__all__ = [n for n in dir() if not n.startswith("_")]
