"""Column functions: each takes columns and returns a column, evaluated in the JVM."""

from ..operators.guard import claims, injections, ratio_check, redact, references, sanitize_input
from ..operators.metrics import folder_of, has_any, loc, module_of, share
from ..operators.search import question_hops, question_target, question_type, symbol_score
from ..operators.similarity import cosine, hash_embedding, line_windows
from ..sinks import safe_id
from ..sources.files import language_of, normal_url
from ..sources.manifests import base_name, is_pinned

__all__ = [
    "base_name", "claims", "cosine", "folder_of", "has_any", "hash_embedding", "injections", "is_pinned", "language_of", "line_windows", "loc", "module_of", "normal_url",
    "question_hops", "question_target", "question_type", "ratio_check", "redact", "references", "safe_id", "sanitize_input", "share", "symbol_score",
]
