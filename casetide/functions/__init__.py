"""See the package README section for the operators of this folder."""
