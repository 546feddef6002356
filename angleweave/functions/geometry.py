"""Placement and superposition of one chain, in numpy alone."""

from __future__ import annotations

#: Ideal lengths (N-CA, CA-C, C-N) and angles (N-CA-C, CA-C-N, C-N-CA, degrees).
LENGTHS = (1.458, 1.525, 1.329)
ANGLES = (111.2, 116.2, 121.7)


def place(a, b, c, length: float, angle: float, torsion: float):
    """The atom at length from c, at angle to b-c, at torsion around it."""
    import numpy as np

    bc = (c - b) / np.linalg.norm(c - b)
    n = np.cross(b - a, bc)
    n /= np.linalg.norm(n)
    return c + length * (-np.cos(angle) * bc + np.sin(angle) * (np.cos(torsion) * np.cross(n, bc) + np.sin(torsion) * n))


def build(phi, psi, omega=None):
    """Coordinates (L, 3, 3) of N, CA, C."""
    import numpy as np

    n = len(phi)
    omega = np.full(n, np.pi) if omega is None else omega
    a1, a2, a3 = np.radians(ANGLES)
    x = np.zeros((n, 3, 3))
    x[0, 1, 0] = LENGTHS[0]
    x[0, 2] = x[0, 1] + LENGTHS[1] * np.array([-np.cos(a1), np.sin(a1), 0])
    for i in range(1, n):
        x[i, 0] = place(*x[i - 1], LENGTHS[2], a2, psi[i - 1])
        x[i, 1] = place(x[i - 1, 1], x[i - 1, 2], x[i, 0], LENGTHS[0], a3, omega[i])
        x[i, 2] = place(x[i - 1, 2], x[i, 0], x[i, 1], LENGTHS[1], a1, phi[i])
    return x


def placed(a, b, c, length: float, angle: float, torsion):
    """place() for many atoms at once: rows of a, b, c and a torsion for each."""
    import numpy as np

    def crossed(u, v):
        return np.stack([u[:, 1] * v[:, 2] - u[:, 2] * v[:, 1], u[:, 2] * v[:, 0] - u[:, 0] * v[:, 2], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]], axis=1)

    def unit(v):
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

    bc = unit(c - b)
    n = unit(crossed(b - a, bc))
    return c + length * (-np.cos(angle) * bc + np.sin(angle) * (np.cos(torsion)[:, None] * crossed(n, bc) + np.sin(torsion)[:, None] * n))


def build_many(phi, psi, sizes):
    """build() of many chains that lie one after another (sizes: residues of each), place by place side by side: (rows, 3, 3)."""
    import numpy as np

    sizes = np.asarray(sizes)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    order = np.argsort(-sizes, kind="stable")
    start, left = start[order], -sizes[order]
    x = np.zeros((len(phi), 3, 3))
    a1, a2, a3 = np.radians(ANGLES)
    x[start, 1, 0] = LENGTHS[0]
    x[start, 2] = x[start, 1] + LENGTHS[1] * np.array([-np.cos(a1), np.sin(a1), 0])
    for i in range(1, int(sizes.max(initial=0))):
        # The chains that are longer than i are the first ones.
        at = start[: np.searchsorted(left, -i, side="left")] + i
        before, straight = x[at - 1], np.full(len(at), np.pi)
        n = placed(before[:, 0], before[:, 1], before[:, 2], LENGTHS[2], a2, psi[at - 1])
        ca = placed(before[:, 1], before[:, 2], n, LENGTHS[0], a3, straight)
        x[at, 0], x[at, 1] = n, ca
        x[at, 2] = placed(before[:, 2], n, ca, LENGTHS[1], a1, phi[at])
    return x


def superposed_many(p, q, sizes):
    """superposed_rmsd() of many sets of points that lie one after another; NaN below three points."""
    import numpy as np

    sizes = np.asarray(sizes)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    total = lambda v: np.add.reduceat(v, start, axis=0)
    centred = lambda v: v - np.repeat(total(v) / sizes[:, None], sizes, axis=0)
    p, q = centred(p), centred(q)
    out, few = np.full(len(sizes), np.nan), sizes >= 3
    # A set with an undefined coordinate has no deviation.
    cross = total(p[:, :, None] * q[:, None, :])
    few &= np.isfinite(cross).all(axis=(1, 2))
    u, s, vt = np.linalg.svd(cross[few])
    s[:, -1] *= np.sign(np.linalg.det(u @ vt))
    square = total((p * p).sum(axis=1) + (q * q).sum(axis=1))[few]
    out[few] = np.sqrt(np.maximum(0.0, (square - 2 * s.sum(axis=1)) / sizes[few]))
    return out


def superposed_rmsd(p, q) -> float:
    """R03 (Kabsch)."""
    import numpy as np

    p, q = p - p.mean(axis=0), q - q.mean(axis=0)
    u, s, vt = np.linalg.svd(p.T @ q)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return float(np.sqrt(max(0.0, ((p * p).sum() + (q * q).sum() - 2 * s.sum()) / len(p))))
