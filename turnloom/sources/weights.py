"""Weights of small networks as .npz files, with the shapes that other tools leave: nested names, rows and columns swapped."""

from __future__ import annotations

import io
import re
from pathlib import PurePosixPath

import numpy as np
import pyarrow.fs

Layers = list[tuple[np.ndarray, np.ndarray]]


def natural_key(name: str) -> list:
    """Runs of digits count as numbers: layer2 before layer10."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name)]


def save_weights(layers: Layers, uri: str) -> None:
    """One .npz under the URI, written beside and moved, so that a reader never sees half of it."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    box = io.BytesIO()
    np.savez(box, **{f"layers.{i}.{part}": x for i, pair in enumerate(layers) for part, x in zip(("weight", "bias"), pair, strict=True)})
    fs.create_dir(str(PurePosixPath(path).parent), recursive=True)
    with fs.open_output_stream(path + ".part") as out:
        out.write(box.getvalue())
    fs.move(path + ".part", path)


def flat(tree: dict, prefix: str = "") -> dict[str, np.ndarray]:
    """A nested dict of arrays as one level of dotted names."""
    out: dict[str, np.ndarray] = {}
    for k, v in tree.items():
        name = f"{prefix}{k}"
        out |= flat(v, name + ".") if isinstance(v, dict) else {name: np.asarray(v, float)}
    return out


def layers_of(tree: dict, n_in: int | None = None) -> Layers:
    """Layers of a (nested) state dict, in the natural order of their names. A matrix whose rows are the outputs is turned.

    Every matrix needs the vector of the same prefix, and widths have to follow each other; anything else is an error.
    """
    arrays = flat(tree)
    stems = sorted({re.sub(r"\.?(weight|bias|kernel|W|b)$", "", n) for n in arrays}, key=natural_key)
    layers: Layers = []
    width = n_in
    for stem in stems:
        mine = {n: x for n, x in arrays.items() if re.sub(r"\.?(weight|bias|kernel|W|b)$", "", n) == stem}
        w = [x for x in mine.values() if x.ndim == 2]
        b = [x for x in mine.values() if x.ndim == 1]
        if len(w) != 1 or len(b) != 1 or not np.isfinite(w[0]).all() or not np.isfinite(b[0]).all():
            raise ValueError(f"{stem}: one finite matrix and one finite vector are needed")
        m = w[0]
        straight = m.shape[1] == len(b[0]) and width in (None, m.shape[0])
        turned = m.shape[0] == len(b[0]) and width in (None, m.shape[1])
        if not straight and not turned:
            raise ValueError(f"{stem}: {m.shape} doesn't follow a width of {width} with {len(b[0])} outputs")
        layers.append((m if straight else m.T, b[0]))
        width = len(b[0])
    if not layers:
        raise ValueError("no layers")
    return layers


def load_weights(uri: str, n_in: int | None = None) -> Layers:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as box:
        return layers_of({n: box[n] for n in box.files}, n_in)


def newest(uri: str, suffix: str = ".npz") -> str:
    """The file of a folder that comes last in natural order (step10 after step9)."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    names = [i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(path)) if i.path.endswith(suffix)]
    if not names:
        raise FileNotFoundError(uri)
    best = max(names, key=lambda n: natural_key(PurePosixPath(n).name))
    return uri.rstrip("/") + "/" + PurePosixPath(best).name
