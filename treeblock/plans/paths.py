"""The path grammar: steps between slashes, [n] an index, quotes for a key, a bare step either, backslash escapes."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Characters that a bare key escapes (fixed values).
SPECIAL = "/{}[].&*\\"


class PathError(ValueError):
    """A path that is not well formed."""


@dataclass(frozen=True)
class Step:
    """key: as a mapping's entry; index: as a sequence's element; either may be None."""

    key: str | None
    index: int | None


def escape(key: str) -> str:
    return re.sub(r"([/{}\[\].&*\\])", r"\\\1", key)


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]

    @classmethod
    def parse(cls, text: str) -> Path:
        steps, i, n = [], 0, len(text)
        while i < n:
            if text[i] == "/":
                i += 1
                continue
            if text[i] == "[":
                end = text.find("]", i)
                if end < 0:
                    raise PathError(f"no ] after [ in {text!r}")
                if not re.fullmatch(r"[-+]?[0-9]+", text[i + 1 : end]):
                    raise PathError(f"{text[i : end + 1]!r} is no index")
                steps.append(Step(None, int(text[i + 1 : end])))
                i = end + 1
            elif text[i] in "'\"":
                quote, key, i = text[i], "", i + 1
                while i < n and text[i] != quote:
                    i += text[i] == "\\" and i + 1 < n
                    key += text[i]
                    i += 1
                if i >= n:
                    raise PathError(f"no closing {quote} in {text!r}")
                steps.append(Step(key, None))
                i += 1
            else:
                key, bare = "", True
                while i < n and text[i] not in "/[":
                    if text[i] == "\\":
                        i, bare = i + 1, False
                        if i >= n:
                            raise PathError(f"{text!r} ends in an escape")
                    key += text[i]
                    i += 1
                steps.append(Step(key, int(key) if bare and re.fullmatch(r"-?[0-9]+", key) else None))
                continue
            if i < n and text[i] not in "/[":
                raise PathError(f"/ expected at {i} of {text!r}")
        return cls(tuple(steps))

    def canonical(self) -> list[str]:
        """The node_path of the path; a bare number is the same as key and as index."""
        return ["/" + "/".join(escape(s.key) if s.key is not None else str(s.index) for s in self.steps)]
