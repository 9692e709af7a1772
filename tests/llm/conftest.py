"""This folder is a package, as modules of the folder above have the same names; its modules still find each other."""

import sys
from pathlib import Path

sys.path.append(str(Path(__file__).resolve().parent))
