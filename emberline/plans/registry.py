"""All queries of the core, and their SQL."""

from __future__ import annotations

from emberline.plans import entries, extras, files, functions, games, labels, nested, samples, streams

_PARTS = (nested, functions, games, entries, samples, streams, extras, labels, files)
#: Columns whose type DuckDB makes wider than Spark does: sums of counts, lengths of lists.
_TYPES = {
    "INTEGER": {
        "fn_fenced_labels": ["speech_chars"], "fn_message_rows": ["assistant_turns", "n_roles"], "fn_info_sections": ["bodies", "n_tasks", "n_done"], "fn_known_impostors": ["roster_size"],
        "fn_matchup_sides": ["n_events"], "fn_rendered": ["messages"], "t_phase_map": ["n"],
    },
    "BIGINT": {
        "g_vote_audit": ["numeric_outcomes"], "g_majority_belief": ["wolf_beliefs"], "g_alive_at_vote": ["alive", "wolves_alive"], "g_win_rates": ["wolf_wins", "good_wins"], "e_belief_shift": ["better", "worse"],
        "e_room_witnesses": ["crew_witnesses"], "t_entry_roles": ["agree", "unsaid"], "s_auto_weights": ["good", "bad"], "s_unions": ["no_lang", "no_role"],
        "x_interval_pairs": ["speeches"], "x_balanced_batches": ["good", "bad"],
        "t_skip_counts": ["no_phase", "no_prompt", "no_response", "many_tries", "no_json"],
    },
}


def _typed(name: str, sql: str) -> str:
    casts = [f'CAST("{c}" AS {kind}) AS "{c}"' for kind, by_query in _TYPES.items() for c in by_query.get(name, [])]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: _typed(name, sql) for part in _PARTS for name, sql in getattr(part, "ORACLE", {}).items()}
FLAGSHIP = nested.p3_found
