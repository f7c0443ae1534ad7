"""Errors, divided by what the caller can do about them."""

from __future__ import annotations


class EvlogError(Exception):
    """Root of all errors of this package."""

    @property
    def is_busy(self) -> bool:
        return isinstance(self, Busy)

    @property
    def is_timeout(self) -> bool:
        return isinstance(self, Timeout)

    @property
    def is_corruption(self) -> bool:
        return isinstance(self, Corruption)


class Validation(EvlogError):
    """The input is wrong; retrying it unchanged fails again."""


class Busy(EvlogError):
    """Another writer held the lock past the deadline; try again."""


class Timeout(EvlogError):
    """A statement ran past its deadline and was stopped."""


class StorageError(EvlogError):
    """The file system or Spark failed."""


class Corruption(EvlogError):
    """Stored data isn't what was written."""


class Unsupported(EvlogError):
    """The value or statement has no meaning here."""


class Truncated(EvlogError):
    """History before the cursor was removed."""

    def __init__(self, requested: int, removed_up_to: int):
        super().__init__(f"asked from {requested}, but history up to {removed_up_to} was removed")
        self.requested, self.removed_up_to = requested, removed_up_to


class HeadMismatch(EvlogError):
    """A stream isn't where the caller expected it. ``None`` stands for a stream never written."""

    def __init__(self, expected: int | None, actual: int | None):
        super().__init__(f"expected {expected}, the stream is at {actual}")
        self.expected, self.actual = expected, actual


class ConsumerBehind(EvlogError):
    """A registered consumer hasn't handled what is to be removed."""

    def __init__(self, consumer: str, cursor: int, up_to: int):
        super().__init__(f"consumer {consumer} is at {cursor}, behind {up_to}")
        self.consumer, self.cursor, self.up_to = consumer, cursor, up_to


class NotExported(EvlogError):
    """What is to be removed isn't covered by confirmed exports."""

    def __init__(self, up_to: int, exported_through: int):
        super().__init__(f"removal reaches {up_to}, confirmed exports reach {exported_through}")
        self.up_to, self.exported_through = up_to, exported_through
