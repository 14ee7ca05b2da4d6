"""Driver-side helpers: result cache, deferred values, time budgets."""

from .budget import Budget, Phase, Plan
from .lazy import Lazy
from .memo import Memo, cache_key

__all__ = ["Budget", "Lazy", "Memo", "Phase", "Plan", "cache_key"]
