"""Tables that each epoch adds to: what an epoch writes depends on what came in it, not on all that came before.

An epoch's rows are a run of their own.  Every :data:`FAN`-th run is written as one with the others of its size
before it, so that after n epochs there are fewer than ``FAN`` runs of each size and log(n) sizes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import folder_names, remove_folder

#: Runs that are written together as one.
FAN = 8


def runs_of(epochs: int) -> list[tuple[int, int]]:
    """The runs (first and last epoch) after so many epochs, oldest and largest first."""
    size, found, at = 1, [], 0
    while size * FAN <= epochs:
        size *= FAN
    while at < epochs:
        while at + size > epochs:
            size //= FAN
        found.append((at, at + size - 1))
        at += size
    return found


def run_path(folder: str, run: tuple[int, int]) -> str:
    return f"{folder}/{run[0]:012d}-{run[1]:012d}"


def merged_into(epoch: int) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """The run that an epoch writes, and the older runs that become part of it."""
    run = runs_of(epoch + 1)[-1]
    return run, [older for older in runs_of(epoch) if older[0] >= run[0]]


def remove_old_runs(spark: SparkSession, folder: str, epoch: int) -> None:
    """Remove what neither the state after an epoch nor that before it has; the latter is still read."""
    kept = {run_path(folder, run) for n in (epoch, epoch + 1) for run in runs_of(n)}
    for name in folder_names(spark, folder):
        if f"{folder}/{name}" not in kept:
            remove_folder(spark, f"{folder}/{name}")
