"""Modules: named values behind parameters.

A module is a class with annotated attributes as parameters, those without a default
required; a default may use the parameters before it. Methods and values whose name
begins with a capital are exported. ``make`` checks and binds parameters, ``from_flags``
reads them from command-line text.
"""

from __future__ import annotations

import argparse
import inspect
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any, get_type_hints

from .digests import value_digest


class ParamError(TypeError):
    """Parameters that a module does not have, lacks or has of another type."""


class FileParam(str):
    """A URL of a file."""


class DirParam(str):
    """A URL of a directory."""


class Default:
    """A default computed from the parameters before it."""

    def __init__(self, f: Callable[[dict[str, Any]], Any]):
        self.f = f


_FLAGS: dict[type, Callable[[str], Any]] = {str: str, int: int, float: float, bool: lambda s: {"true": True, "1": True, "false": False, "0": False}[s.lower()], FileParam: FileParam, DirParam: DirParam}


class Module:
    """Base of modules."""

    @classmethod
    def params(cls) -> dict[str, tuple[type, Any]]:
        """name: (type, default), in order; a required one has inspect.Parameter.empty."""
        return {n: (t, getattr(cls, n, inspect.Parameter.empty)) for n, t in get_type_hints(cls).items() if not n.startswith("_")}

    @classmethod
    def make(cls, **given: Any) -> Module:
        own = cls.params()
        problems = [f"unknown parameter {n}" for n in given if n not in own]
        out, env = cls(), {}
        for n, (t, default) in own.items():
            if n in given:
                v = given[n]
                if t is float and type(v) is int:
                    v = float(v)
                if isinstance(t, type) and (not isinstance(v, t) or t is int and isinstance(v, bool)):
                    if not (t in (FileParam, DirParam) and isinstance(v, str)):
                        problems.append(f"parameter {n} has type {type(v).__name__}, not {t.__name__}")
                        continue
            elif default is inspect.Parameter.empty:
                problems.append(f"missing parameter {n}")
                continue
            elif problems and isinstance(default, Default):
                continue  # what it is made of may be what is missing
            else:
                v = default.f(env) if isinstance(default, Default) else default
            env[n] = v
            setattr(out, n, v)
        if problems:
            raise ParamError("; ".join(problems))
        out._params = env
        return out

    @classmethod
    def from_flags(cls, argv: list[str]) -> Module:
        """From -name value text; only types that have a text form are flags."""
        parser = argparse.ArgumentParser(prog=cls.__name__, description=cls.__doc__, exit_on_error=False)
        for n, (t, default) in cls.params().items():
            if t in _FLAGS:
                parser.add_argument(f"-{n}", f"--{n}", type=_FLAGS[t], default=argparse.SUPPRESS, required=default is inspect.Parameter.empty, help=f"{t.__name__}")
        try:
            return cls.make(**vars(parser.parse_args(argv)))
        except (argparse.ArgumentError, SystemExit, KeyError) as e:
            raise ParamError(str(e)) from e

    @classmethod
    def exports(cls) -> dict[str, Any]:
        """Members whose name begins with a capital."""
        return {n: getattr(cls, n) for n in dir(cls) if n[:1].isupper()}

    @classmethod
    def doc(cls) -> str:
        """The module's description, parameters and members."""
        lines = [inspect.getdoc(cls) or "", "", "Parameters"]
        lines += [f"  {n} {t.__name__}" + ("" if d is inspect.Parameter.empty else " (defaulted)" if isinstance(d, Default) else f" = {d!r}") for n, (t, d) in cls.params().items()]
        lines += ["", "Declarations", *[f"  {n}: {(inspect.getdoc(v) or '').splitlines()[0] if inspect.getdoc(v) else ''}" for n, v in cls.exports().items()]]
        return "\n".join(lines)

    def digest(self) -> str:
        """Digest of the module's name and parameters."""
        return value_digest([type(self).__name__, {k: v for k, v in self._params.items() if isinstance(v, (str, int, float, bool, list, tuple, dict))}])


def bundle(target: str, *modules: str) -> str:
    """A zip of module files with a manifest, usable as --py-files; its digest is of contents alone."""
    import hashlib

    names = sorted(modules)
    sums = {Path(n).name: hashlib.sha256(Path(n).read_bytes()).hexdigest() for n in names}
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(zipfile.ZipInfo(Path(n).name, (1980, 1, 1, 0, 0, 0)), Path(n).read_bytes())
        z.writestr(zipfile.ZipInfo("MANIFEST", (1980, 1, 1, 0, 0, 0)), "\n".join(f"{v}  {k}" for k, v in sums.items()))
    return value_digest(sums)


REGISTRY: dict[str, Callable] = {}


def intrinsic(module: str, name: str) -> Callable[[Callable], Callable]:
    """Register a function under module.name, so that it can be found by that text."""

    def keep(f: Callable) -> Callable:
        REGISTRY[f"{module}.{name}"] = f
        return f

    return keep
