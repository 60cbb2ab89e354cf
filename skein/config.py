"""Defaults and fixed values.

Values under "fixed values" must equal the behaviour we reproduce for results
to match; everything else is a tunable default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must not change: results depend on them)
# ---------------------------------------------------------------------------

# Default regex pre-filters, applied in order, each match replaced by one space.
DEFAULT_PRE_FILTERS = (
    r"[\r\t]",
    r"[\ \n._|-]{2,}",
    r"^[\r\n\ ._|-]+",
)
# Default tokens removed from each chunk after chunking.
DEFAULT_POST_FILTER = ("\n",)
# Default chunk separators and chunk size (tokens).
DEFAULT_SEPARATORS = (" ",)
DEFAULT_CHUNK_MAX_TOKENS = 255
# Default context size of a session (tokens).
DEFAULT_CONTEXT_SIZE = 512
# Namespace of content ids (UUID version 5 of the chunk text).
CONTENT_ID_NAMESPACE = "067FB304-F9B1-4E74-8ACA-28051B8492AB"
# Token bias constants: allowed / forbidden.
BIAS_ALLOW = 10000.0
BIAS_FORBID = -10000.0
# Sampler chain defaults.
SAMPLER_TOP_K = 40
SAMPLER_TOP_P = 0.95
SAMPLER_REPEAT_PENALTY = 1.30
SAMPLER_TEMPERATURE = 0.80
SAMPLER_REPEAT_LAST_N = 64
# Default number of recalled chunks.
DEFAULT_RECALL_N = 1
# Accepted media types: text is a prefix match, the others exact.
MEDIA_TEXT_PREFIX = "text/plain"
MEDIA_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MEDIA_PDF = "application/pdf"

# ---------------------------------------------------------------------------
# Our own conventions (shared by the Spark code and the SQL oracles)
# ---------------------------------------------------------------------------

# Lossless tokenizer: runs of letters/marks/digits, or any single other char.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}]+|\s|[^\s\p{L}\p{M}\p{N}]"
WORD_PATTERN = r"[\p{L}\p{M}\p{N}]+"
# Feature-hash embedder dimensionality.
HASH_DIMS = 64


@dataclass(frozen=True)
class ChunkConfig:
    separators: tuple[str, ...] = DEFAULT_SEPARATORS
    max_tokens: int = DEFAULT_CHUNK_MAX_TOKENS
    pre_filters: tuple[str, ...] = DEFAULT_PRE_FILTERS
    post_filter: tuple[str, ...] = DEFAULT_POST_FILTER


@dataclass(frozen=True)
class SamplerConfig:
    top_k: int = SAMPLER_TOP_K
    top_p: float = SAMPLER_TOP_P
    repeat_penalty: float = SAMPLER_REPEAT_PENALTY
    temperature: float = SAMPLER_TEMPERATURE
    repeat_last_n: int = SAMPLER_REPEAT_LAST_N


@dataclass(frozen=True)
class TaskConfig:
    """Prompt-side settings of a task (what is data work, not inference)."""

    prelude: str = ""
    prefix: str = ""
    postfix: str = ""
    private_tokens: tuple[str, ...] = ()
    max_tokens: int | None = None
    stop_sequences: tuple[str, ...] = ()
    retrieve: int = 0
    store_prompts: bool = False
    context_size: int = DEFAULT_CONTEXT_SIZE
    sampler: SamplerConfig = field(default_factory=SamplerConfig)
