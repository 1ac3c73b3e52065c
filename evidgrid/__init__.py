"""Evidence analytics on Spark: text events, documents and run logs as DataFrames."""

from evidgrid.lexicon import DEFAULT_LEXICON, Lexicon
from evidgrid.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["DEFAULT_LEXICON", "Lexicon", "build_session", "checkpoint_dir", "cut_lineage"]
