"""Exceptions that carry a code from a closed set."""

from __future__ import annotations

#: The closed sets of reason codes, by family.
CODES = {
    "canonical": ("non_finite_number", "unsupported_type", "undefined_root"),
    "chain": ("content_tampered", "digest_mismatch", "chain_break", "sequence_gap"),
    "log": ("malformed_line", "unknown_kind", "workspace_mismatch"),
    "workspace": ("workspace_unresolved", "lock_timeout"),
    "store": (
        "chain_invalid", "not_found", "already_purged", "duplicate_id", "merge_too_small", "canonical_not_a_member",
        "member_already_merged", "canonical_of_active_merge", "endpoint_not_found", "span_unresolvable", "null_content",
    ),
    "temporal": ("malformed_temporal_value", "ambiguous_timezone", "inverted_window"),
    "causal": ("unknown_edge_type", "not_a_decision", "weight_out_of_range", "invalid_max_depth"),
    "fusion": ("missing_id", "duplicate_id_in_channel", "invalid_k"),
    "retrieval": ("contradictory_decision", "no_candidates", "below_floor"),
    "span": ("source_not_found", "source_purged", "source_has_no_text", "span_out_of_bounds", "span_inverted", "span_not_integral"),
    "link": ("no_candidates", "tie", "weak", "ranked"),
}
_FAMILY = {code: family for family, codes in CODES.items() for code in codes}


class EngineError(ValueError):
    """``code`` is one of CODES; the message holds no record content."""

    def __init__(self, code: str, detail: str = "") -> None:
        if code not in _FAMILY:
            raise AssertionError(f"no such reason code: {code}")
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code
        self.family = _FAMILY[code]
