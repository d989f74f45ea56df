"""SQL templates, rendering and plans."""
