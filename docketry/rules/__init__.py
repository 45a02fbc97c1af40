"""The rule language and its compiler."""
