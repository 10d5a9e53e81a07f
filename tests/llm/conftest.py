"""The tests of this folder share plain evaluators by name."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
