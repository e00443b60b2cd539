"""Reading and writing: images, manifests, faces, prototypes, configuration."""
