"""Tests of the training-data operators: a package, so that files may have names that tests/ has too."""
