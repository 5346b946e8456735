from . import folds, segments, text, topk, vectors

__all__ = ["folds", "segments", "text", "topk", "vectors"]
