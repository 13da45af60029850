"""Settings of a project, with the defaults and the JSON file that may override them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from typing import Any

CONFIG_FILE = "duplication.config.json"

# What is read and skipped in a project, and the tuning constants of the analysis.
DEFAULT_EXCLUDES = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/*.min.*", "**/*.generated.*", "**/migrations/**"]
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".cs", ".java", ".kt", ".go", ".rs", ".rb", ".php", ".py", ".c", ".h", ".cpp", ".hpp", ".cc", ".m", ".swift", ".scala", ".sql", ".sh", ".ps1", ".vb", ".css", ".scss", ".less"]
SKIP_DIRECTORIES = ["node_modules", "dist", "build", "coverage", "bin", "obj", "vendor"]
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_BLOCK_LINES = 120
WINDOW_OVERLAP = 0.5
SIZE_TOLERANCE = 0.3
SCALING_FROM, SCALING_TO, LARGEST_BLOCK_PENALTY, HIGHEST_THRESHOLD = 25, 100, 0.35, 0.98
MIN_ALIGNMENT, MODERATE_ALIGNMENT, HIGH_ALIGNMENT = 0.65, 0.7, 0.75
REDUNDANT_COVERAGE = 0.8
SAME_LINE = 0.5
SIZE_WEIGHT = 1.5
SHORT_BASELINE, LONG_BASELINE = 0.2, 0.57
DEFAULT_TOP = 20
SMALL_PROJECT_FILES, USEFUL_PERCENT, MAX_LISTED = 200, 50, 8
REMEMBERED_FINDINGS = 2000
CONFIDENCE = ["low", "moderate", "high", "certain"]


@dataclass(frozen=True)
class Idiom:
    max_lines: int = 5
    min_occurrences: int = 10
    ignore_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    include: tuple[str, ...] = ("**",)
    exclude: tuple[str, ...] = tuple(DEFAULT_EXCLUDES)
    include_nested_repositories: bool = False
    min_lines: int = 6
    similarity_threshold: float = 0.45
    idiom: Idiom = field(default_factory=Idiom)
    model: str = "structure-64"


#: Names in the file and here.
_NAMES = {"include": "include", "exclude": "exclude", "includeNestedRepositories": "include_nested_repositories", "minLines": "min_lines", "similarityThreshold": "similarity_threshold"}
_IDIOM = {"maxLines": "max_lines", "minOccurrences": "min_occurrences", "ignorePatterns": "ignore_patterns"}


def _value(x: Any) -> Any:
    return tuple(x) if isinstance(x, list) else x


def merged(given: dict[str, Any]) -> Settings:
    """Defaults overlaid with what a file states; ``idiom`` and ``model`` are overlaid name by name."""
    own = {_NAMES[k]: _value(v) for k, v in given.items() if k in _NAMES and v is not None}
    idiom = {_IDIOM[k]: _value(v) for k, v in (given.get("idiom") or {}).items() if k in _IDIOM and v is not None}
    model = (given.get("model") or {}).get("name")
    return replace(Settings(), **own, idiom=replace(Idiom(), **idiom), **({"model": model} if model else {}))


def read_config(root: str) -> Settings | None:
    """The settings that a project states, or None if it has no file. A malformed file is an error."""
    try:
        with open(os.path.join(root, CONFIG_FILE), encoding="utf-8") as f:
            text = f.read()
    except OSError:
        return None
    try:
        return merged(json.loads(text))
    except ValueError as e:
        raise ValueError(f"{CONFIG_FILE} is not valid JSON: {e}") from e


def load_config(root: str) -> Settings:
    return read_config(root) or Settings()


@dataclass(frozen=True)
class Query:
    """What a report is asked for; None means the project's setting."""

    top: int = DEFAULT_TOP
    min_lines: int | None = None
    order_by: str = "severity"
    include_suppressed: bool = False
    min_confidence: str = "low"
    similarity_threshold: float | None = None

    def __post_init__(self) -> None:
        if isinstance(self.top, bool) or not isinstance(self.top, int) or self.top < 0:
            raise ValueError("top must be a whole number of at least 0")
        if self.order_by not in ("severity", "frequency"):
            raise ValueError("order_by must be severity or frequency")
        if self.min_confidence not in CONFIDENCE:
            raise ValueError(f"min_confidence must be one of {', '.join(CONFIDENCE)}")

    def threshold(self, settings: Settings) -> float:
        asked = settings.similarity_threshold if self.similarity_threshold is None else self.similarity_threshold
        return min(1.0, max(0.0, float(asked)))


def fingerprint(settings: Settings) -> str:
    """Changes whenever the scope or the thresholds do."""
    return json.dumps(asdict(settings), sort_keys=True)
