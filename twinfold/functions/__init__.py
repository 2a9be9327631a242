"""Part of twinfold."""
