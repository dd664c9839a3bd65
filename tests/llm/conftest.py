from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures_llm import edge, nothing, small, texts  # noqa: E402, F401  (fixtures)
