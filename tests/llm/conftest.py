import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures_llm import docs_of, documents  # noqa: E402, F401
