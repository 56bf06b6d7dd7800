"""What needs a hardware codec or an operating-system framework: interfaces, registries, and the status `deferred`."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol, runtime_checkable


@dataclass(frozen=True)
class Packet:
    data: bytes
    pts_ns: int
    alpha: bytes | None = None


@runtime_checkable
class VideoDecoder(Protocol):
    decodes_alpha: bool

    def can_decode(self, codec: str) -> bool: ...

    def frames(self, packets: Iterator[Packet]) -> Iterator[tuple[int, bytes]]: ...


@runtime_checkable
class AlphaEncoder(Protocol):
    def can_write(self, extension: str) -> bool: ...

    def write(self, frames: Iterator[tuple[int, bytes]], path: str) -> int: ...


class Deferred(Exception):
    """Nothing here can do it; the item is left as it is."""


class Registry:
    """The last that was registered and fits, wins."""

    def __init__(self) -> None:
        self._all: list = []

    def register(self, one) -> None:
        self._all.append(one)

    def clear(self) -> None:
        self._all.clear()

    def find(self, fits):
        for one in reversed(self._all):
            if fits(one):
                return one
        raise Deferred


decoders, encoders = Registry(), Registry()


def decoder_for(codec: str, alpha: bool = False) -> VideoDecoder:
    """A decoder that can read the codec; a source with alpha is refused, never flattened."""
    found = decoders.find(lambda d: d.can_decode(codec))
    if alpha and not getattr(found, "decodes_alpha", False):
        raise ValueError("the source has alpha and its decoder can't read it")
    return found


def encoder_for(extension: str) -> AlphaEncoder:
    return encoders.find(lambda e: e.can_write(extension))
