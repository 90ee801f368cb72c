"""All queries of this package and their SQL; importing a module registers its own."""

from __future__ import annotations

import tapeworks.llm.collocations  # noqa: F401
import tapeworks.llm.decontamination  # noqa: F401
import tapeworks.llm.html_text  # noqa: F401
import tapeworks.llm.importance  # noqa: F401
import tapeworks.llm.lexical_search  # noqa: F401
import tapeworks.llm.lm  # noqa: F401
import tapeworks.llm.packing  # noqa: F401
import tapeworks.llm.quality_rules  # noqa: F401
import tapeworks.llm.simhash  # noqa: F401
import tapeworks.llm.substrings  # noqa: F401
import tapeworks.llm.surrogates  # noqa: F401
import tapeworks.llm.url_filters  # noqa: F401
import tapeworks.llm.warc  # noqa: F401
from tapeworks.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
