from .filters import PlanError, finalize, predicate, run

__all__ = ["PlanError", "finalize", "predicate", "run"]
