"""DataFrame operators over canonical sheets. None of them runs an action."""
