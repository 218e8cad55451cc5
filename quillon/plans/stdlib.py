"""The standard library by name: ``module.Function`` to what implements it.

Names are those that programs use; each entry is a function of columns, DataFrames or URLs.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import arith, checks, collections, paths, regexps, strings
from ..operators import dirs, filesets
from ..sources import io
from .memo import repeat_and_check
from .modules import intrinsic

MODULES: dict[str, dict[str, Callable]] = {
    "builtin": {
        "len": collections.length,
        "int": arith.to_int,
        "float": arith.to_float,
        "zip": collections.zip_lists,
        "unzip": collections.unzip,
        "flatten": collections.flatten,
        "map": collections.map_of,
        "list": collections.entries,
        "reduce": collections.reduce,
        "fold": collections.fold,
        "range": collections.int_range,
        "panic": arith.panic,
        "error": arith.error,
        "delay": arith.delay,
        "trace": checks.trace,
        "file": io.intern_file,
        "dir": io.intern_dir,
    },
    "test": {"Assert": checks.assert_list, "AssertMap": checks.assert_map, "All": checks.all_hold, "ExecRepeatAndCheck": repeat_and_check},
    "dirs": {
        "Groups": dirs.groups,
        "Make": dirs.make,
        "FromList": dirs.from_list,
        "Sum": dirs.sum_dirs,
        "Pick": dirs.pick,
        "Files": dirs.files,
        "Copy": io.copy_dir,
        "Fileset": filesets.to_dir,
    },
    "files": {"Copy": io.copy_file, "Create": io.create_file, "Fileset": filesets.to_file},
    "regexp": {"Groups": regexps.groups, "Match": regexps.matches, "Replace": regexps.replace},
    "strings": {
        "Split": strings.split,
        "Chunk": strings.chunk,
        "Join": strings.join,
        "HasPrefix": strings.has_prefix,
        "HasSuffix": strings.has_suffix,
        "Sort": strings.sort,
        "FromInt": strings.from_int,
        "FromFloat": strings.from_float,
        "ToFloat": strings.to_float,
    },
    "path": {"Base": paths.base, "Dir": paths.dirname, "Ext": paths.ext, "Join": paths.join},
    "filesets": {"Dir": filesets.of_dir, "File": filesets.of_file},
}
#: Sizes in bytes.
CONSTANTS = {"KiB": checks.KIB, "MiB": checks.MIB, "GiB": checks.GIB, "TiB": checks.TIB}

for _module, _functions in MODULES.items():
    for _name, _function in _functions.items():
        intrinsic(_module, _name)(_function)


def find(name: str) -> Callable:
    """The function of a dotted name; one of no module is a builtin."""
    module, _, function = name.rpartition(".")
    known = MODULES.get(module or "builtin", {})
    if function not in known:
        raise KeyError(name)
    return known[function]


def doc(module: str) -> str:
    """A line for each function of a module."""
    return "\n".join(f"{n}: {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}" for n, f in sorted(MODULES[module].items()))
