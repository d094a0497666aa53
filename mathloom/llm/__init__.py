"""Operations of a training-data pipeline: filtering, deduplication, packing and archiving of text.

Nothing else in the library imports this subpackage.
"""
