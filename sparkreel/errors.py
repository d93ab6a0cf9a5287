"""Errors with a level: what the caller did wrong is a warning, what can't go on is fatal."""

from __future__ import annotations

from enum import Enum


class Level(Enum):
    FATAL = "fatal"
    WARN = "warn"
    LOG = "log"


class EngineError(ValueError):
    """An error with a level, and what else there is to say."""

    default = Level.FATAL

    def __init__(self, message: str, level: Level | None = None, extra: str = "") -> None:
        super().__init__(message)
        self.message, self.level, self.extra = message, level or self.default, extra

    def __str__(self) -> str:
        return self.message + (f" | {self.extra}" if self.extra else "") + (f" (cause: {self.__cause__})" if self.__cause__ else "")


class Warn(EngineError):
    default = Level.WARN


def level_of(error: BaseException | None) -> Level | None:
    """The level of an error, or of the nearest cause that has one."""
    while error is not None:
        if isinstance(error, EngineError):
            return error.level
        error = error.__cause__
    return None


def wrap(cause: BaseException, message: str, extra: str = "") -> EngineError:
    """``message`` because of ``cause``, at the cause's level; a cause without a level is fatal."""
    out = EngineError(message, level_of(cause) or Level.FATAL, extra)
    out.__cause__ = cause
    return out


def is_fatal(error: BaseException | None) -> bool:
    return level_of(error) is Level.FATAL


def status_code(error: BaseException) -> int:
    """What a service answers: 504 out of time, 408 given up, 400 for warnings, 500 for anything else."""
    chain: list[BaseException] = []
    e: BaseException | None = error
    while e is not None:
        chain.append(e)
        e = e.__cause__
    if any(isinstance(x, TimeoutError) for x in chain):
        return 504
    if any(isinstance(x, KeyboardInterrupt | InterruptedError) for x in chain):
        return 408
    return 400 if level_of(error) is Level.WARN else 500
