"""Transactions over DataFrames: a candidate is a new lineage; commit rebinds, rollback forgets it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from pareframe.sources.tables import keep


class Aborted(Exception):
    """Raised by an action that gives its candidate up."""


class TransactionFailed(Exception):
    """An action failed for another reason; the snapshot is as before."""


@dataclass
class Snapshot:
    """Versioned state; ``log`` has an entry for each transaction."""

    data: DataFrame
    version: int = 0
    log: list[tuple[int, str]] = field(default_factory=list)

    def transaction(self, action: Callable[[DataFrame], DataFrame]) -> bool:
        """Whether the action's result became the new state."""
        try:
            then = keep(action(self.data))
        except Aborted:
            self.log.append((self.version, "aborted"))
            return False
        except Exception as error:
            self.log.append((self.version, "failed"))
            raise TransactionFailed(str(error)) from error
        self.data, self.version = then, self.version + 1
        self.log.append((self.version, "committed"))
        return True
