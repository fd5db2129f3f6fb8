"""What a host sets: folders and language, and what a change of language asks for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from siftwell.functions.text import EN_STOPWORDS, HANGUL_LEADS, TENSE


@dataclass(frozen=True)
class Language:
    """How texts of a language are embedded, split and listed."""

    label: str
    embedder: str
    tokenizer: str = "unicode61"
    stopwords: tuple[str, ...] = ()
    letters: tuple[str, ...] = ()
    bigrams: bool = True


# Languages, and the embedder and tokenizer whose change makes an index stale.
LANGUAGES = {
    "en": Language("English", "nomic-embed-text", stopwords=EN_STOPWORDS, letters=tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), bigrams=False),
    "ja": Language("日本語 (Japanese)", "bge-m3"),
    "ko": Language("한국어 (Korean)", "bge-m3", letters=tuple(c for c in HANGUL_LEADS if c not in TENSE)),
    "zh": Language("简体中文 (Simplified Chinese)", "bge-m3"),
    "zh-hant": Language("繁體中文 (Traditional Chinese)", "bge-m3"),
}


def language_code(code: str | None) -> str:
    """A code of LANGUAGES; case is ignored, and unknown ones and none are English."""
    low = (code or "").strip().lower()
    return low if low in LANGUAGES else "en"


def language(code: str | None) -> Language:
    return LANGUAGES[language_code(code)]


def rebuild_required(old: str | None, new: str | None) -> bool:
    """Whether a change of language needs new embeddings or a new index."""
    a, b = language(old), language(new)
    return (a.embedder, a.tokenizer) != (b.embedder, b.tokenizer)


@dataclass(frozen=True)
class Options:
    """Folders of documents and of stored tables, and the language."""

    doc_dir: str = ""
    work_dir: str = ""
    lang: str = "en"
    extra_dirs: tuple[str, ...] = field(default=())

    def roots(self, override: str | None = None) -> list[str]:
        """Folders to scan: override alone, else the main one and the others in order, each once."""
        if override:
            return [override]
        return [d for d in dict.fromkeys([self.doc_dir, *sorted(self.extra_dirs)]) if d]


def read_options(texts: Iterable[str | None], environment: Mapping[str, str] | None = None, prefix: str = "SIFTWELL_") -> Options:
    """Options from the first of texts that is there ("key = value" lines, "#" comments), then from the environment; empty values change nothing."""
    given: dict[str, str] = {}
    for line in (next((t for t in texts if t is not None), "")).splitlines():
        key, mark, value = line.partition("=")
        if mark and not line.strip().startswith("#"):
            given[key.strip().lower()] = value.strip()
    for key in ("doc_dir", "work_dir", "lang"):
        given[key] = (environment or {}).get(prefix + key.upper(), "").strip() or given.get(key, "")
    named = {key: given[key] for key in ("doc_dir", "work_dir") if given[key]}
    return replace(Options(lang=language_code(given["lang"])), **named)
