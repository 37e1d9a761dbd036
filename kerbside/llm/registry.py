"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, near, sessions, vafile, warc
from .align import op13_token_alignment
from .chat import op3_chat_format
from .decontaminate import op2_benchmark_decontamination
from .langid import op6_language_id
from .lines import op10_line_dedup
from .lm import op7_lm_scoring
from .media import op1_media_columns
from .near import op4_ngram_jaccard_join
from .pieces import op5_sentencepiece
from .sessions import op12_late_sessions
from .urlfilter import op9_url_filter
from .vafile import op11_exact_topk
from .warc import op8_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns,
        op2_benchmark_decontamination,
        op3_chat_format,
        op4_ngram_jaccard_join,
        op5_sentencepiece,
        op6_language_id,
        op7_lm_scoring,
        op8_warc,
        op9_url_filter,
        op10_line_dedup,
        op11_exact_topk,
        op12_late_sessions,
        op13_token_alignment,
    )
}
SQL: dict[str, str] = {"op3_chat_format": chat.SQL, "op4_ngram_jaccard_join": near.SQL, "op8_warc": warc.SQL, "op11_exact_topk": vafile.SQL, "op12_late_sessions": sessions.SQL}
