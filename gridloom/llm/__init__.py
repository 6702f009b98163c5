"""Training-data operators: corpus components that share nothing with the gridded engine.

Nothing outside this package imports it; removing the folder leaves the rest intact.
"""
